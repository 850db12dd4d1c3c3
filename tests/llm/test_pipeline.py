"""Each stage of the pipeline on its own input, against brute force and laws."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fleetscope.llm.common import stored
from tests.llm import brute
from tests.llm.brute import DOC_SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "step"))
    return out


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_rules_drop_what_fails_the_base(steps):
    good = {r.doc_id for r in steps[0].collect() if not brute.base_figures(r.text)[-1]}
    assert set(_ids(steps[1])) <= good and len(_ids(steps[1])) > 0.6 * len(good)


def test_one_document_of_each_class_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert _ids(steps[2]) == sorted({c for _, c, _ in brute.similar(rows)})


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    bad = {d for d, n, hit, _ in brute.contamination(rows, items) if hit and 20 * hit >= n}
    assert bad and _ids(steps[3]) == sorted({d for d, _ in rows} - bad)


def test_the_mixture_is_sharded_whole(steps):
    assert _ids(steps[4]) == _ids(steps[5]) and set(_ids(steps[4])) <= set(_ids(steps[3]))
    assert {r.shard for r in steps[5].collect()} == set(range(8))


def test_run_gives_the_same_rows(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in steps[-1].collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_nulls_and_empty_tables(spark, k):
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(None, None, None, None, None), (1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, "", None, "s", 0), (None, text, "en", None, 9)]
    for docs in (spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame([], DOC_SCHEMA)):
        more = docs.withColumns({"kept": F.lit(1), "root": F.lit(2), "_own": F.lit(3), "set": F.lit(4)})
        for table in (docs, more):
            got = corpus_pipeline.STAGES[k][1](spark, table, SF)
            assert got.columns[: len(table.columns)] == table.columns and got.count() <= docs.count()


def test_copies_leave_one_row(spark):
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(3, text, "en", "s", 9), (3, text, "en", "s", 9), (4, text + " more", "en", "s", 9), (5, "other " * 9, "en", "s", 9), (3, "two texts of one id", "en", "s", 9)]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOC_SCHEMA), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, text), (3, "two texts of one id"), (5, "other " * 9)])


def test_a_rare_source_takes_nothing_from_the_others(spark):
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(60))
    rows = [(n, text(n), "en" if n % 5 else "de", "s" if n % 4 else "u", 9) for n in range(400)] + [(1000, text(1000), "en", "stray", 9)]
    got = _ids(corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOC_SCHEMA), SF))
    assert len(set(got)) > 0.85 * len(rows) and got.count(1000) > 1
    assert abs(len(got) / len(rows) - 1) < 0.1  # texts of equal length: rows stand for tokens
