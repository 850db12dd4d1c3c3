"""Queries of the operators that learn from, join or sample the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import jaccard_join, mil_quality, mixing

THRESHOLD = 0.3


def tokens() -> Column:
    """Words of the text, as the weight of a document."""
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))


def margins() -> dict[str, Column]:
    """``documents`` has no topic, so the kind of text stands for it."""
    size = F.coalesce(F.length("text"), F.lit(0))
    topic = F.when(F.contains("text", F.lit(" | ")), "tables").when(size < 1000, "notes").when(size < 4000, "articles").otherwise("essays")
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}


#: Targets: the tokens of a source, language or topic to these powers.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Token budget as a share of the input's tokens: what large cells lose, small cells gain in copies.
BUDGET_SHARE = 1.0


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links")


def op4_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~held_out("doc_id"))
    scored = mil_quality.score_quality(docs, mil_quality.fit_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix_to_targets(docs, margins(), tokens(), powers=POWERS, budget_share=BUDGET_SHARE)
    return mixed.select("doc_id", "source", "lang", margins()["topic"].alias("topic"), "tokens", "probability", "copies")


QUERIES = {"op2_jaccard_join": op2_jaccard_join, "op4_mil_quality": op4_mil_quality, "op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
