"""Registered queries next to their SQL on the smallest tables; ``tests/oracle_check.py`` runs all of them."""

from __future__ import annotations

import pytest

from fleetscope.catalog.all_queries import ORACLES, QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = [
    "gc_pressure", "memory_spill", "data_skew", "task_failures", "sql_anomalies", "stage_failures", "diagnostic_report", "recommendations",
    "jobs_report", "stages_report", "executors_report", "cluster_report", "executors_total", "task_quantiles", "ring_buffer", "slot_asof",
    "staleness", "throttle", "state_transition", "ingest_jobs", "ingest_executors", "run_assign", "conf_diff", "run_delete",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.slow
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in QUICK])
def test_every_other_query_equals_sql(spark, con, name):
    spark.catalog.clearCache()
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["stage_retries", "executors_total", "sql_median"])
def test_partition_count_does_not_matter(spark, name):
    got = []
    for partitions in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append(sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]
