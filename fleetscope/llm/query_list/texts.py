"""Queries of the operators that judge or encode texts one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontamination, quality_rules, token_files
from fleetscope.llm.common import new_path

END_ID = 2


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules.compression_bands(docs).drop("text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_path(spark, "token-files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, END_ID)
    return token_files.read_token_files(manifest, folder)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = F.array_join(F.sort_array("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP9_SQL = r"""
with raw as (select 0 kind, doc_id id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') t from documents
 union all select 1, item_id, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from raw),
items as (select id item, ws, len(ws) n, least(len(ws), 13) m from w where kind = 1 and len(ws) > 0),
iw as (select distinct item, m, array_to_string(ws[p:p+m-1], ' ') win from (select item, ws, m, unnest(range(1, n-m+2)) p from items)),
lens as (select distinct m from items),
dw as (select id, m, p, array_to_string(ws[p:p+m-1], ' ') win from (select w.id, l.m, w.ws, unnest(range(1, len(w.ws)-l.m+2)) p from w, lens l where kind = 0 and len(ws) >= l.m)),
hits as (select dw.id, dw.p, dw.m, iw.item from dw join iw using (m, win)),
covered as (select id, count(distinct q) n_hit from (select id, unnest(range(p, p+m)) q from hits) group by id),
its as (select id, count(distinct item) n_items, string_agg(distinct item::varchar, ',' order by item::varchar) names from hits group by id)
select w.id doc_id, len(w.ws)::bigint n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, sha256(coalesce(names,'')) items_sha256,
 coalesce(n_hit,0) > 0 and 20*coalesce(n_hit,0) >= len(w.ws) contaminated
from w left join covered c on c.id = w.id left join its on its.id = w.id where kind = 0
"""

QUERIES = {"op3_compression_bands": op3_compression_bands, "op5_token_files": op5_token_files, "op9_decontamination": op9_decontamination}
ORACLES = {"op9_decontamination": OP9_SQL}
