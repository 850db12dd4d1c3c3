"""Queries of the operators that look for repeats across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import suffix_dedup


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, p, substr(h, 2*p+1, 100) s from (select doc_id, h, unnest(range(0, (length(h)//2 - 49)::bigint)) p from d)),
f as (select s, min(doc_id) first from w group by s having count(*) > 1),
hit as (select w.doc_id, p from w join f using (s) where first < w.doc_id),
st as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 50 or lag(p) over (partition by doc_id order by p) is null then 1 else 0 end new from hit),
g as (select doc_id, p, sum(new) over (partition by doc_id order by p) k from st),
r as (select doc_id, k, min(p) a, max(p) + 50 b from g group by doc_id, k),
pieces as (select r.doc_id, a, b, lag(b, 1, 0) over (partition by r.doc_id order by a) before from r),
kept as (select p.doc_id, string_agg(substr(d.h, 2*before+1, 2*(a-before)), '' order by a) hs, max(b) last, sum(b-a)::bigint removed, count(*) n from pieces p join d using (doc_id) group by p.doc_id)
select d.doc_id, length(d.h)//2 n_bytes, coalesce(removed, 0) n_removed, coalesce(n, 0) n_spans,
 sha256(unhex(case when n is null then d.h else hs || substr(d.h, 2*last+1) end)) kept_sha256
from d left join kept using (doc_id)
"""

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES = {"op1_suffix_dedup": OP1_SQL}
