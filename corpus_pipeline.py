"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from fleetscope.llm.common import stored
from fleetscope.llm.query_list.corpus import BUDGET_SHARE, POWERS, margins, tokens
from fleetscope.llm.query_list.texts import contaminated

SHARDS = 8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the compression bands accept."""
    judged = quality_rules.compression_bands(docs)
    return judged.filter("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id; of rows that repeat it, one."""
    key = lambda c: F.coalesce(F.col(c), F.lit(jaccard_join.NO_ID))
    firsts = jaccard_join.near_duplicates(docs).filter("first").select(key("doc_id").alias("_id"), F.col("_print").alias("_own")).distinct()
    marked = docs.withColumns({"_id": key("doc_id"), "_own": F.xxhash64(F.coalesce("text", F.lit("")))})
    # join and removal of repeated rows share one exchange, being on the same keys
    return marked.join(firsts, ["_id", "_own"], "left_semi").dropDuplicates(["_id", "_own"]).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~contaminated()).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of sources, languages and topics and are as many as the input's.

    A document of a cell that is raised has a row for each of its copies.
    """
    mixed = mixing.mix_to_targets(docs, margins(), tokens(), powers=POWERS, budget_share=BUDGET_SHARE)
    return mixed.filter("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes, with each document's place in its shard."""
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no zstandard, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL = None
