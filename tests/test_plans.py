"""How often the big tables are read, and results at ties whatever the partitioning."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fleetscope.catalog.all_queries import QUERIES
from fleetscope.plans import history, runs
from fleetscope.plans.insights import by_category
from fleetscope.plans.recording import record
from fleetscope.plans.report import DiagnosticPlan
from fleetscope.schemas import Telemetry
from fleetscope.sources.sample_views import BASE_TABLES, SampleViews

SF = "/root/testdata/sf0.001"


def scans(df, table: str) -> int:
    """Planned reads of a table; a kept result is computed once however often the plan shows it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:|+*-]*", line)[0])
    seen: set[str] = set()

    def walk(part: list[str]) -> int:
        found = at = 0
        while at < len(part):
            line, at = part[at], at + 1
            if "InMemoryRelation" in line:
                end = next((i for i in range(at, len(part)) if depth(part[i]) <= depth(line)), len(part))
                own = re.sub(r"[#:|+* -]|\d+L?|plan_id=\d+", "", "".join(part[at:end]))
                if own not in seen:
                    seen.add(own)
                    found += walk(part[at:end])
                at = end
            elif "FileScan" in line:
                found += f"/{table}.parquet" in line
        return found

    return walk(lines)


@pytest.fixture(autouse=True)
def nothing_kept(spark):
    """What earlier tests kept would show as already computed."""
    spark.catalog.clearCache()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")


@pytest.mark.parametrize("name", ["diagnostic_report", "insight_union", "insight_rank", "insight_sequence", "health_components", "health_score", "top_recommendations", "health_history", "accumulate"])
def test_reports_read_the_tasks_twice(spark, name):
    assert scans(QUERIES[name](spark, SF), "lineitem") <= 2


@pytest.mark.parametrize("name", ["task_quantiles", "is_skewed", "partition_issues"])
def test_single_results_read_the_tasks_twice(spark, name):
    assert scans(QUERIES[name](spark, SF), "lineitem") <= 2


@pytest.mark.parametrize("name", ["task_quantiles", "is_skewed"])
def test_quantiles_count_the_values_once(spark, name):
    """Both sides of the join of values and bands read the exchange of the same count."""
    df = QUERIES[name](spark, SF)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_episodes_and_stopped_runs_hold_the_findings_twice_at_most(spark):
    """The plan of all findings is large; repeated by every step that reads it, it outgrew the driver."""
    nodes = lambda df: df._jdf.queryExecution().analyzed().toString().count("rank_metric")
    plan = DiagnosticPlan(SampleViews(spark, SF).telemetry, store=True)
    once = nodes(plan.insights)
    assert nodes(QUERIES["insight_episodes"](spark, SF)) <= 2 * once
    assert nodes(QUERIES["insight_export"](spark, SF)) <= 2 * once


def test_kept_facts_have_few_parts_whatever_the_shuffle_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        plan = DiagnosticPlan(SampleViews(spark, SF).telemetry, store=True)
        parts = plan.tables.executors._jdf.queryExecution().toRdd().getNumPartitions()
        assert 0 < parts <= 4 * spark.sparkContext.defaultParallelism < 150
        plan.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_runs_take_findings_without_ticks_as_one_row(spark):
    views = SampleViews(spark, SF)
    plan = DiagnosticPlan(views.telemetry, store=True)
    ticks, wanted = views.executors.select("cluster_id", "tick").distinct(), views.view("runs")
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    copied = runs.stop_runs(plan.insights, ticks, wanted)
    assert text(runs.stop_runs(plan.passing, ticks, wanted, plan.standing).select(*copied.columns)) == text(copied)
    plan.release()


def test_recorded_tables_share_the_findings(spark):
    """Each table of a run took the findings from the source tables again."""
    views = SampleViews(spark, SF)
    plan = DiagnosticPlan(views.telemetry, store=True)
    read = {}

    class Saved:
        def save(self, table, rows):
            leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
            read[table] = [leaves.apply(i).toString() for i in range(leaves.size())]

    started = views.view("runs").withColumn("conf", F.create_map().cast("map<string,string>"))
    record(Saved(), plan, started, F.col("tick"), ("run_health", "run_insights"))
    assert set(read) == {"run_health", "run_insights"}
    assert not [leaf for leaves in read.values() for leaf in leaves if "o_orderkey" in leaf and "InMemoryRelation" not in leaf]
    assert not plan.passing.storageLevel.useMemory  # given back
    plan.release()


def test_plans_are_built_without_jobs(spark):
    views = SampleViews(spark, SF)
    for name in (*BASE_TABLES, "runs"):
        views.view(name)  # reads the files' footers
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = DiagnosticPlan(views.telemetry, store=True)
    found = history.accumulate(plan.insights, plan.spine, ["cluster_id"])
    assert plan.report.columns and history.top_issues(found, ["cluster_id"]).columns
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    # the one exception: the greedy gap lengthens its pointers in rounds, each of them checkpointed
    assert runs.snapshots(plan.health, views.view("runs"), F.col("tick")).columns
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) > len(before)
    plan.release()


@pytest.mark.parametrize("ordinals", [None, {21}])
def test_findings_of_unchanging_tables_are_not_copied_to_the_ticks(spark, ordinals):
    views = SampleViews(spark, SF)
    rules = [r for r in DiagnosticPlan(views.telemetry).rules if ordinals is None or r.ordinal in ordinals]
    plan = DiagnosticPlan(views.telemetry, rules=rules, store=True)
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    columns = by_category(plan.insights).columns
    assert text(plan.categories.select(*columns)) == text(by_category(plan.insights))
    copied = history.accumulate(plan.insights, plan.spine, ["cluster_id"])
    held = history.accumulate(plan.passing, plan.spine, ["cluster_id"], standing=plan.standing)
    assert text(held.select(*copied.columns)) == text(copied)
    datasets = plan.scope("rdd").count()
    assert 0 < plan.standing.count() <= datasets * sum(r.scope == "rdd" for r in rules for _ in r.findings())
    assert plan.insights.filter("rule = 'partial_cache'").count() >= plan.standing.filter("rule = 'partial_cache'").count()
    plan.release()


def test_a_standing_and_a_passing_finding_of_one_identity_are_one(spark):
    views = SampleViews(spark, SF)
    plan = DiagnosticPlan(views.telemetry, store=True)
    some = plan.standing.filter("cluster_id in ('c0', 'c1')")
    ticks = plan.spine.filter("tick % 10 = 2")
    again = some.join(ticks, "cluster_id").withColumns({"metric_value": F.lit(1e9), "severity_rank": F.lit(0)})
    copies = again.unionByName(plan.standing.join(plan.spine, "cluster_id"))
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    latest_ties = ["severity", "metric_value", "threshold_value", "description", "recommendation"]
    want = history.accumulate(copies, plan.spine, ["cluster_id"]).drop(*latest_ties)
    got = history.accumulate(again, plan.spine, ["cluster_id"], standing=plan.standing).drop(*latest_ties)
    assert text(got) == text(want) and got.filter("peak_metric_value = 1e9").count() > 0
    plan.release()


EXECUTOR = (
    "cluster_id string, tick int, executor_id string, pos long, is_active boolean, completed_tasks long, total_shuffle_read long,"
    " total_duration_ms long, total_gc_time_ms long, total_cores int, max_tasks int"
)


#: Sample deviation over mean is exactly one half, the bound of the rule.
TIES = [(1, 2, 3), (2, 4, 6), (1, 5, 5, 5), (7, 14, 21), (3, 15, 15, 15), (11, 22, 33)]


@pytest.mark.parametrize("partitions", [1, 2, 13])
def test_a_deviation_equal_to_its_bound_is_found(spark, partitions):
    rows = []
    for tick in range(60):
        counts = [c * (tick + 1) for c in TIES[tick % len(TIES)]]
        rows += [("c", tick, str(n), n, True, c, 100, 1000, 10, 4, 4) for n, c in enumerate(counts)]
    frame = spark.createDataFrame(rows, EXECUTOR).repartition(partitions, "executor_id", "tick")
    found = DiagnosticPlan(Telemetry(frame)).detect("data_skew").collect()
    assert sorted(r.tick for r in found if r.title.startswith("Task distribution")) == list(range(60))


STAGE = "cluster_id string, tick int, stage_id int, pos long, status string, executor_run_time_ms long, executor_cpu_time_ns long, num_tasks int"


@pytest.mark.parametrize("partitions", [1, 2, 13])
def test_a_mean_equal_to_its_bound_makes_no_finding(spark, partitions):
    """Cpu shares with a mean of exactly 0.7, which the rule must exceed."""
    shares = (0.6, 0.7, 0.8, 0.65, 0.75, 0.55, 0.85)
    rows = [("c", tick, n, n, "ACTIVE", 1000, int(round(s * 1e9)), 4) for tick in range(40) for n, s in enumerate(shares[: 3 + 2 * (tick % 3)])]
    stages = spark.createDataFrame(rows, STAGE).repartition(partitions, "stage_id", "tick")
    executors = spark.createDataFrame([("c", t, "1", 0, True, 1, 100, 1000, 10, 4, 4) for t in range(40)], EXECUTOR)
    assert DiagnosticPlan(Telemetry(executors, stages=stages)).detect("cpu_io_classification").count() == 0
