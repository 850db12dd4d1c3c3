"""Points inside intervals, against comparing every pair."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import intervals
from fleetscope.plans import runs
from fleetscope.sources import event_log


def _brute(points, spans):
    return sorted(
        (c, t, name, r) for c, t, name in points for k, r, a, b in spans
        if None not in (c, t, a) and c == k and t >= a and (b is None or t <= b)
    )


@pytest.mark.parametrize("width", [50, 5000, 1 << 40])
def test_equals_all_pairs(spark, width):
    draw = random.Random(width)
    points = [(draw.choice("ab"), draw.randrange(-width, width), f"p{i % 9}") for i in range(300)] + [("a", None, "x"), (None, 3, "x")]
    points += [("c", 7, "hot")] * 20
    spans = []
    for i in range(120):
        a = draw.randrange(-width - 5, width + 5)
        spans.append((draw.choice("abd"), f"r{i}", a, draw.choice([None, a, a - 1, a + draw.randrange(width)])))
    spans += [("a", "none", None, 9), (None, "none", 0, 9), ("c", "one", 7, 7), ("a", "all", -(1 << 62), 1 << 62), ("b", "twice", 0, 5), ("b", "twice", 0, 5)]
    left = spark.createDataFrame(points, "k string, t long, name string")
    right = spark.createDataFrame(spans, "k string, r string, a long, b long")
    got = intervals.inside(left, right, ["k"], "t", "a", "b").select("k", "t", "name", "r").collect()
    assert sorted(tuple(r) for r in got) == _brute(points, spans)


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], "k string, t long"), spark.createDataFrame([("a", "r", 1, None)], "k string, r string, a long, b long")
    assert intervals.inside(left, right, ["k"], "t", "a", "b").count() == 0
    assert intervals.inside(spark.createDataFrame([("a", 2)], "k string, t long"), right.limit(0), ["k"], "t", "a", "b").count() == 0


def _joined_rows(df):
    """Rows that each join of the executed plan put out."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
            return
        if "QueryStage" in name:
            walk(node.plan())
            return
        if "Join" in name:
            out.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return out


def test_one_cluster_with_ten_thousand_runs_makes_no_rows_but_results(spark):
    ticks = spark.range(200_000).select(F.lit("c0").alias("cluster_id"), F.col("id").alias("tick"))
    windows = spark.range(10_000).select(
        F.lit("c0").alias("cluster_id"), F.format_string("r%d", "id").alias("run_id"), (F.col("id") * 20).alias("start_tick"), (F.col("id") * 20 + 39).alias("stop_tick")
    )
    found = runs.assign(ticks, windows)
    rows = 10_000 * 40 - 20
    assert max(_joined_rows(found)) == rows
    assert found.count() == rows and found.select("tick").distinct().count() == 200_000


def test_an_interval_has_few_nodes(spark):
    spans = spark.createDataFrame([(0, 1 << 41), (5, (1 << 36) + 77), (63, 64), (9, 9)], "a long, b long")
    rows = intervals.interval_nodes(spans, "a", "b", "nodes").collect()
    for r in rows:
        assert len(r.nodes) <= 2 * 63 * intervals.LEVELS
        assert sum(1 << (intervals.BITS * n.level) for n in r.nodes) == r.b - r.a + 1


def test_queries_of_a_log_are_spread_over_its_ticks_once(spark):
    """Jobs of a query were counted on a second copy of the queries at their ticks."""
    lines = [
        {"Event": f"{event_log.SQL}Start", "executionId": 1, "time": 1000},
        {"Event": f"{event_log.SQL}Start", "executionId": 2, "time": 2500},
        *[{"Event": "SparkListenerJobStart", "Job ID": j, "Submission Time": 1000, "Properties": {event_log.EXECUTION_ID: "1"}} for j in (5, 4, 3, 2)],
        {"Event": "SparkListenerJobEnd", "Job ID": 5, "Completion Time": 2000, "Job Result": {"Result": "JobFailed"}},
        {"Event": "SparkListenerJobEnd", "Job ID": 4, "Completion Time": 3000, "Job Result": {"Result": "JobFailed"}},
        {"Event": "SparkListenerJobEnd", "Job ID": 3, "Completion Time": 2000, "Job Result": {"Result": "JobSucceeded"}},
        {"Event": f"{event_log.SQL}End", "executionId": 1, "time": 3000},
    ]
    rows = spark.createDataFrame([("c", json.dumps(line)) for line in lines], "cluster_id string, value string")
    found = event_log.EventLog(event_log.parse_events(rows), 1).sql_queries
    assert found._jdf.queryExecution().analyzed().toString().count("explode(_nodes") == 1
    got = {(r.tick, r.execution_id): (r.status, r.running_jobs, r.success_jobs, list(r.failed_job_ids)) for r in found.collect()}
    assert got == {
        (1, 1): ("RUNNING", 4, 0, []), (2, 1): ("RUNNING", 2, 1, [5]), (3, 1): ("COMPLETED", 1, 1, [4, 5]),
        (2, 2): ("RUNNING", 0, 0, []), (3, 2): ("RUNNING", 0, 0, []),
    }


def test_tables_of_a_log_read_its_lines_once_and_from_flat_columns_on_disk(spark):
    """Events were kept whole, with their nested columns, in memory that ran out over 72 million of them."""
    info = {"Stage ID": 3, "Stage Attempt ID": 1, "Stage Name": "s", "Number of Tasks": 2, "Submission Time": 1000}
    metrics = {"Executor Run Time": 5, "JVM GC Time": 2, "Shuffle Read Metrics": {"Remote Bytes Read": 7}}
    task = {"Event": event_log.TASK_END, "Stage ID": 3, "Stage Attempt ID": 1, "Task End Reason": {"Reason": "Success"}, "Task Metrics": metrics,
            "Task Info": {"Task ID": 1, "Launch Time": 1000, "Finish Time": 2000, "Executor ID": "e", "Failed": False, "Killed": False}}
    lines = [
        {"Event": "SparkListenerApplicationStart", "App Name": "app", "Timestamp": 1000},
        {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"k": "v"}},
        {"Event": "SparkListenerExecutorAdded", "Timestamp": 1000, "Executor ID": "e", "Executor Info": {"Host": "h", "Total Cores": 4}},
        {"Event": "SparkListenerExecutorRemoved", "Timestamp": 3000, "Executor ID": "e", "Removed Reason": "lost"},
        {"Event": "SparkListenerJobStart", "Job ID": 5, "Submission Time": 1000, "Stage IDs": [3], "Stage Infos": [info], "Properties": {"spark.job.description": "d"}},
        {"Event": "SparkListenerStageSubmitted", "Stage Info": info}, task, task | {"Task End Reason": {"Reason": "Killed", "Description": "x"}},
        {"Event": "SparkListenerStageCompleted", "Stage Info": info | {"Completion Time": 3000, "Failure Reason": "boom"}},
        {"Event": "SparkListenerBlockManagerAdded", "Timestamp": 2500, "Executor ID": "other"},
    ]
    rows = spark.createDataFrame([("c", json.dumps(line)) for line in lines] + [("c", "no object")], "cluster_id string, value string")
    log = event_log.EventLog(event_log.parse_events(rows), 1)
    assert not [f.name for f in log.facts.schema if f.dataType.typeName() == "struct"]
    assert not log.facts.storageLevel.useMemory and not log.job_spans.storageLevel.useMemory
    tables = log.telemetry
    for table in (tables.executors, tables.stages, tables.jobs, tables.sql_queries, tables.clusters):
        leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
        assert {leaves.apply(i).nodeName() for i in range(leaves.length())} == {"InMemoryRelation"}
    assert sorted((r.tick, r.status, r.name, r.num_tasks, r.num_complete_tasks, r.num_killed_tasks, r.num_failed_tasks, r.shuffle_read_bytes, r.executor_run_time_ms, r.failure_reason)
                  for r in tables.stages.collect()) == [
        (1, "ACTIVE", "s", 2, 0, 0, 0, 0, 0, None), (2, "ACTIVE", "s", 2, 1, 0, 1, 14, 10, None), (3, "FAILED", "s", 2, 0, 0, 0, 0, 0, "boom"),
    ]
    assert sorted((r.tick, r.executor_id, r.is_active, r.host_port, r.total_cores, r.completed_tasks, r.total_duration_ms, r.total_gc_time_ms, r.remove_reason)
                  for r in tables.executors.collect()) == [
        (1, "e", True, "h", 4, 0, 0, 0, ""), (2, "e", True, "h", 4, 1, 2000, 4, ""), (3, "e", False, "h", 4, 0, 0, 0, "lost"),
    ]
    assert sorted((r.tick, r.job_id, r.name, r.num_tasks, r.stage_ids) for r in tables.jobs.collect()) == [(t, 5, "d", 2, [3]) for t in (1, 2, 3)]
    assert [(r.cluster_name, r.spark_conf) for r in tables.clusters.collect()] == [("app", {"k": "v"})]
    assert [r.task_id for r in log.tasks.collect()] == [1, 1]
