"""Every rule below, at and above its bounds. Each case is a cluster, so one job checks them all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetscope.plans.insights import SCHEMAS, with_ids, with_rank
from fleetscope.plans.report import DiagnosticPlan
from fleetscope.schemas import KEY, Telemetry

GIB, MIB = 1024**3, 1024**2
EXECUTOR = dict(
    executor_id="1", is_active=True, total_cores=4, max_tasks=4, active_tasks=4, completed_tasks=100, failed_tasks=0, total_duration_ms=600000,
    total_gc_time_ms=6000, max_memory=16 * GIB, memory_used=4 * GIB, disk_used=0, total_shuffle_read=1000000, total_shuffle_write=500000,
    peak_jvm_heap=0, remove_reason="", is_excluded=False,
)
STAGE = dict(
    stage_id=1, attempt_id=0, status="ACTIVE", num_tasks=200, num_active_tasks=10, num_complete_tasks=180, num_failed_tasks=0, num_killed_tasks=0,
    input_bytes=GIB, shuffle_read_bytes=0, shuffle_write_bytes=0, memory_spill_bytes=0, disk_spill_bytes=0, executor_run_time_ms=100000,
    executor_cpu_time_ns=50_000_000_000, failure_reason=None,
)
SQL = dict(execution_id=1, status="COMPLETED", duration_ms=1000, running_jobs=0, success_jobs=1, failed_job_ids=[])
KRYO = {"spark.serializer": "org.apache.spark.serializer.KryoSerializer"}


def case(executors=None, stages=(), jobs=("RUNNING",), sqls=(), rdds=(), conf=None, minutes=60, engine="STANDARD", expect=(), history=None):
    executors = [{}, {"executor_id": "2"}] if executors is None else executors
    return dict(executors=executors, stages=stages, jobs=jobs, sqls=sqls, rdds=rdds, conf=conf or {}, minutes=minutes, engine=engine, expect=sorted(expect), history=history)


def two(**a):
    return [a, {"executor_id": "2"}]


def spread(*values, field="total_shuffle_read"):
    return [{"executor_id": str(i + 1), field: x} for i, x in enumerate(values)]


CASES = {
    "healthy": case(expect=[]),
    # garbage collection
    "gc_below": case(two(total_gc_time_ms=29999), expect=[]),
    "gc_warn": case(two(total_gc_time_ms=30000), expect=["gc_pressure:WARNING:1"]),
    "gc_crit": case(two(total_gc_time_ms=60000), expect=["gc_pressure:CRITICAL:1"]),
    "gc_driver_skipped": case([{}, {"executor_id": "driver", "total_gc_time_ms": 12000}], expect=[]),
    "gc_driver_alone": case([{"executor_id": "driver", "total_gc_time_ms": 60000}], expect=["gc_pressure:CRITICAL:driver"]),
    "gc_dead": case(two(total_gc_time_ms=60000, is_active=False), expect=[]),
    # spill
    "spill_warn": case(stages=[{"memory_spill_bytes": 1}], expect=["memory_spill:WARNING:stage_1"]),
    "spill_disk_at": case(stages=[{"disk_spill_bytes": GIB, "input_bytes": 2 * GIB}], expect=["memory_spill:WARNING:stage_1"]),
    "spill_disk_over": case(stages=[{"disk_spill_bytes": GIB + 1, "input_bytes": 4 * GIB}], expect=["memory_spill:CRITICAL:stage_1"]),
    "spill_over_input": case(stages=[{"memory_spill_bytes": GIB + 1}], expect=["memory_spill:CRITICAL:stage_1"]),
    "spill_pending": case(stages=[{"memory_spill_bytes": GIB + 1, "status": "PENDING"}], expect=[]),
    # skew
    "skew_below": case(spread(100, 100, 299), expect=[]),
    "skew_warn": case(spread(100, 100, 300), expect=["data_skew:WARNING:3"]),
    "skew_crit": case(spread(100, 100, 500), expect=["data_skew:CRITICAL:3"]),
    "skew_tie": case(spread(500, 500, 100, 100, 100), expect=["data_skew:CRITICAL:1"]),
    "task_cov_warn": case(spread(100, 220, field="completed_tasks"), expect=["data_skew:WARNING:"]),
    "task_cov_crit": case(spread(10, 10, 10, 400, field="completed_tasks"), expect=["data_skew:CRITICAL:"]),
    # shuffle, partitions, stragglers
    "shuffle_below": case(stages=[{"shuffle_read_bytes": GIB // 2 - 1}], expect=[]),
    "shuffle_warn": case(stages=[{"shuffle_read_bytes": GIB // 2}], expect=["shuffle_bottleneck:WARNING:stage_1"]),
    "shuffle_crit": case(stages=[{"shuffle_write_bytes": 2 * GIB}], expect=["shuffle_bottleneck:CRITICAL:stage_1"]),
    "part_large_at": case(stages=[{"input_bytes": 256 * MIB * 200}], expect=[]),
    "part_large": case(stages=[{"input_bytes": 256 * MIB * 200 + 200}], expect=["partition_issues:WARNING:stage_1"]),
    "part_tiny": case(stages=[{"input_bytes": MIB * 20 - 20, "num_tasks": 20, "num_complete_tasks": 10}], expect=["partition_issues:WARNING:stage_1"]),
    "part_few": case(stages=[{"num_tasks": 7, "num_complete_tasks": 3}], expect=["partition_issues:WARNING:stage_1"]),
    "part_enough": case(stages=[{"num_tasks": 8, "num_complete_tasks": 3}], expect=[]),
    "straggler_warn": case(stages=[{"num_complete_tasks": 198, "num_active_tasks": 2}], expect=["straggler_tasks:WARNING:stage_1"]),
    "straggler_crit": case(stages=[{"num_complete_tasks": 199, "num_active_tasks": 1}], expect=["straggler_tasks:CRITICAL:stage_1"]),
    "straggler_lone": case(stages=[{"num_complete_tasks": 195, "num_active_tasks": 1}], expect=["straggler_tasks:WARNING:stage_1"]),
    "straggler_early": case(stages=[{"num_complete_tasks": 190, "num_active_tasks": 1}], expect=[]),
    # utilization
    "util_at": case(
        [{"total_cores": 5, "max_tasks": 5, "active_tasks": 4}, {"executor_id": "2", "total_cores": 5, "max_tasks": 5, "active_tasks": 3}], expect=[]
    ),
    "util_warn": case([{"active_tasks": 2}, {"executor_id": "2", "active_tasks": 2}], expect=["cluster_utilization:WARNING:"]),
    "util_crit": case([{"active_tasks": 1}, {"executor_id": "2", "active_tasks": 1}], expect=["cluster_utilization:CRITICAL:"]),
    "util_idle_jobs": case([{"active_tasks": 1}, {"executor_id": "2", "active_tasks": 1}], jobs=["SUCCEEDED"], expect=[]),
    "util_cores": case([{"active_tasks": 1, "max_tasks": 0}, {"executor_id": "2", "active_tasks": 1, "max_tasks": 0}], expect=["cluster_utilization:CRITICAL:"]),
    # task failures
    "fail_few": case([{"completed_tasks": 4, "failed_tasks": 5}], expect=[]),
    "fail_warn": case([{"completed_tasks": 98, "failed_tasks": 1}, {"executor_id": "2", "completed_tasks": 100, "failed_tasks": 1}], expect=["task_failures:WARNING:"]),
    "fail_crit": case([{"completed_tasks": 95, "failed_tasks": 5}, {"executor_id": "2", "completed_tasks": 95, "failed_tasks": 5}], expect=["task_failures:CRITICAL:"]),
    "fail_hot": case([{"completed_tasks": 999, "failed_tasks": 3}, {"executor_id": "2", "completed_tasks": 999, "failed_tasks": 2}], expect=["task_failures:WARNING:1"]),
    # memory
    "mem_warn": case(two(memory_used=int(16 * GIB * 0.8) + 1), expect=["memory_pressure:WARNING:1"]),
    "mem_crit": case(two(memory_used=int(16 * GIB * 0.95) + 1), expect=["memory_pressure:CRITICAL:1"]),
    "heap_below": case(two(peak_jvm_heap=int(16 * GIB * 0.849)), expect=[]),
    "heap_warn": case(two(peak_jvm_heap=int(16 * GIB * 0.85) + 1), expect=["memory_pressure:WARNING:1"]),
    "heap_crit": case(two(peak_jvm_heap=int(16 * GIB * 0.95) + 1), expect=["memory_pressure:CRITICAL:1"]),
    "heap_hidden": case(two(peak_jvm_heap=16 * GIB, memory_used=int(16 * GIB * 0.81)), expect=["memory_pressure:WARNING:1"]),
    # configuration
    "aqe_off": case(conf={"spark.sql.adaptive.enabled": "FALSE", "spark.sql.adaptive.skewJoin.enabled": "false"}, expect=["aqe_config:CRITICAL:"]),
    "aqe_parts": case(
        conf={"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "31m"},
        expect=["aqe_config:INFO:", "aqe_config:WARNING:", "aqe_config:WARNING:", "config_anti_patterns:WARNING:"],
    ),
    "aqe_advisory_at": case(conf={"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB"}, expect=[]),
    "serial_warn": case(spread(30000, 30000, field="total_gc_time_ms"), conf={"spark.serializer": "java"}, expect=["gc_pressure:WARNING:1", "gc_pressure:WARNING:2", "serialization:WARNING:"]),
    "serial_crit": case(spread(60000, 60000, field="total_gc_time_ms"), conf={"spark.serializer": "java"}, expect=["gc_pressure:CRITICAL:1", "gc_pressure:CRITICAL:2", "serialization:CRITICAL:"]),
    "serial_shuffle": case(spread(5 * GIB, 5 * GIB), conf={"spark.serializer": "java"}, expect=["serialization:WARNING:"]),
    "conf_fraction": case(conf={"spark.memory.fraction": "0.39", "spark.memory.storageFraction": "0.71", "spark.sql.autoBroadcastJoinThreshold": " -1 "}, expect=["config_anti_patterns:INFO:", "config_anti_patterns:INFO:", "config_anti_patterns:WARNING:"]),
    "conf_fine": case(conf={"spark.memory.fraction": "0.8", "spark.memory.storageFraction": "0.7", "spark.sql.shuffle.partitions": "many"}, expect=[]),
    "conf_parts_at": case(conf={"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, expect=["aqe_config:WARNING:"]),
    "timeout_off": case(minutes=0, expect=["auto_termination:WARNING:"]),
    "timeout_idle": case([{"active_tasks": 0}, {"executor_id": "2", "active_tasks": 0}], jobs=["SUCCEEDED"], minutes=0, expect=["auto_termination:CRITICAL:"]),
    "timeout_at": case(minutes=120, expect=[]),
    "timeout_long": case(minutes=121, expect=["auto_termination:INFO:"]),
    # sizing and driver
    "size_heap_at": case([{"max_memory": 64 * GIB}], expect=[]),
    "size_heap": case([{"max_memory": 64 * GIB + 1}], expect=["executor_sizing:WARNING:1"]),
    "size_cores": case([{"total_cores": 9, "max_tasks": 9, "active_tasks": 9, "max_memory": 32 * GIB}], expect=["executor_sizing:WARNING:1"]),
    "size_per_core": case([{"max_memory": 8 * GIB - 4}], expect=["executor_sizing:WARNING:1"]),
    "driver_gc": case([{}, {"executor_id": "driver", "total_gc_time_ms": 30001}], expect=["driver_bottleneck:WARNING:driver"]),
    "driver_gc_low": case([{}, {"executor_id": "driver", "total_gc_time_ms": 30000}], expect=[]),
    "driver_mem": case([{}, {"executor_id": "driver", "memory_used": int(16 * GIB * 0.96)}], expect=["driver_bottleneck:CRITICAL:driver", "memory_pressure:CRITICAL:driver"]),
    # SQL
    "photon_five": case(sqls=[{"execution_id": i} for i in range(5)], expect=[]),
    "photon_six": case(sqls=[{"execution_id": i} for i in range(6)], expect=["photon_opportunity:INFO:"]),
    "photon_many": case(sqls=[{"execution_id": i, "duration_ms": 60001} for i in range(21)], expect=["photon_opportunity:WARNING:"]),
    "photon_on": case(sqls=[{"execution_id": i} for i in range(6)], engine="photon", expect=[]),
    "sql_long": case(sqls=[{"status": "RUNNING", "duration_ms": 600001}], expect=["sql_anomalies:INFO:sql_1"]),
    "sql_warn": case(sqls=[{"execution_id": i, "duration_ms": 20000} for i in range(3)] + [{"execution_id": 9, "duration_ms": 100000}], expect=["sql_anomalies:WARNING:sql_9"]),
    "sql_crit": case(sqls=[{"execution_id": i, "duration_ms": 20000} for i in range(3)] + [{"execution_id": 9, "duration_ms": 200000}], expect=["sql_anomalies:CRITICAL:sql_9"]),
    "sql_one": case(sqls=[{"execution_id": 9, "duration_ms": 200000}], expect=[]),
    "sql_failed": case(sqls=[{"failed_job_ids": [3, 4]}], expect=["sql_anomalies:WARNING:sql_1"]),
    # I/O and CPU
    "io_small": case(stages=[{"input_bytes": 101 * MIB - 101, "num_tasks": 101, "num_complete_tasks": 90}], expect=["io_patterns:WARNING:stage_1", "partition_issues:WARNING:stage_1"]),
    "io_bound": case(stages=[{"status": "COMPLETE", "executor_cpu_time_ns": 29_999_999_999}], expect=["io_patterns:WARNING:stage_1"]),
    "cpu_bound": case(stages=[{"executor_cpu_time_ns": 70_000_000_001}], expect=["cpu_io_classification:INFO:"]),
    "io_bound_active": case(stages=[{"executor_cpu_time_ns": 29_999_999_999}], expect=["cpu_io_classification:INFO:", "io_patterns:WARNING:stage_1"]),
    # stages
    "retry": case(stages=[{"attempt_id": 1}], expect=["stage_retries:WARNING:stage_1"]),
    "retry_many": case(stages=[{"attempt_id": 1}, {"stage_id": 2, "attempt_id": 3}], expect=["stage_retries:CRITICAL:", "stage_retries:CRITICAL:stage_2", "stage_retries:WARNING:stage_1"]),
    "retry_all_crit": case(stages=[{"attempt_id": 3}, {"stage_id": 2, "attempt_id": 4}], expect=["stage_retries:CRITICAL:stage_1", "stage_retries:CRITICAL:stage_2"]),
    "join": case(
        stages=[{"status": "COMPLETE", "num_tasks": 50, "num_complete_tasks": 50, "input_bytes": 100 * MIB - 1, "shuffle_read_bytes": 500 * MIB}],
        expect=["join_strategy:WARNING:stage_1", "shuffle_bottleneck:CRITICAL:stage_1"],
    ),
    "failed_oom": case(stages=[{"status": "FAILED", "failure_reason": "java.lang.OUTOFMEMORYERROR"}], expect=["stage_failures:CRITICAL:stage-1"]),
    "failed_fetch": case(stages=[{"status": "FAILED", "failure_reason": "Connection reset by peer"}], expect=["stage_failures:CRITICAL:stage-1"]),
    "failed_other": case(stages=[{"status": "FAILED", "failure_reason": "x" * 300}], expect=["stage_failures:WARNING:stage-1"]),
    "failed_silent": case(stages=[{"status": "FAILED", "failure_reason": ""}], expect=[]),
    "killed_info": case(stages=[{"num_killed_tasks": 20}], expect=["killed_tasks:INFO:"]),
    "killed_warn": case(stages=[{"num_killed_tasks": 21}], expect=["killed_tasks:WARNING:"]),
    # removals and cache
    "removed": case(
        [{}, *[{"executor_id": str(i), "is_active": False, "remove_reason": r} for i, r in enumerate(["Container killed by YARN", "exceeding memory", "worker lost", "shuffle gone", "decommissioned"], 5)]],
        expect=["executor_failures:CRITICAL:", "executor_failures:CRITICAL:", "executor_failures:WARNING:", "executor_failures:WARNING:"],
    ),
    "excluded": case(two(is_excluded=True), expect=["executor_failures:WARNING:"]),
    "cache_partial": case(rdds=[{"rdd_id": 1, "num_partitions": 100, "num_cached_partitions": 49}, {"rdd_id": 2, "num_partitions": 2, "num_cached_partitions": 1}], expect=["caching_issues:WARNING:rdd_1"]),
    "cache_empty": case(rdds=[{"rdd_id": 1, "num_partitions": 0, "num_cached_partitions": 0}], expect=["caching_issues:WARNING:rdd_1"]),
    "cache_memory": case(rdds=[{"rdd_id": 1, "num_partitions": 1, "num_cached_partitions": 1, "memory_used": 20 * GIB}], expect=["caching_issues:WARNING:"]),
    # executor count over polls: 1, 1, 2 swings too much; two polls are too few
    "count_swing": case(history=[1, 1, 2], expect=["dynamic_allocation:WARNING:"]),
    "count_short": case(history=[1, 3], expect=[]),
    "count_steady": case(history=[4, 4, 4], expect=[]),
}
TICK = 100


def _tables(spark):
    executors, stages, jobs, sqls, rdds, conf = ([] for _ in range(6))
    for name, c in CASES.items():
        lead = dict(cluster_id=name, tick=TICK)
        for pos, e in enumerate(c["executors"]):
            executors.append({**lead, "pos": pos, **EXECUTOR, **e})
        for back, count in enumerate(reversed(c["history"] or [])):
            if back == 0:
                executors[:] = [e for e in executors if e["cluster_id"] != name]
            executors += [{**lead, "tick": TICK - back, "pos": i, **EXECUTOR, "executor_id": str(i + 1)} for i in range(count)]
        stages += [{**lead, "pos": i, **STAGE, **s} for i, s in enumerate(c["stages"])]
        jobs += [{**lead, "pos": i, "job_id": i, "status": s, "num_failed_tasks": 0} for i, s in enumerate(c["jobs"])]
        sqls += [{**lead, "pos": i, **SQL, **q} for i, q in enumerate(c["sqls"])]
        rdds += [{**lead, "pos": i, "name": "", "memory_used": 0, **r} for i, r in enumerate(c["rdds"])]
        conf.append({**lead, "spark_conf": {**KRYO, **c["conf"]}, "autotermination_minutes": c["minutes"], "runtime_engine": c["engine"]})
    kinds = {"cluster_id": "string", "tick": "int", "pos": "bigint"}

    def frame(rows, table):
        schema = {**kinds, **SCHEMAS[table]}
        names = [n for n in schema if n in rows[0]]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {schema[n]}" for n in names))

    return Telemetry(frame(executors, "executors"), frame(stages, "stages"), frame(jobs, "jobs"), frame(sqls, "sql_queries"), frame(rdds, "rdds"), frame(conf, "clusters"))


@pytest.fixture(scope="module")
def plan(spark):
    return DiagnosticPlan(_tables(spark), store=True)


@pytest.fixture(scope="module")
def insights(plan):
    return plan.insights.filter(F.col("tick") == TICK).collect()


def test_every_bound(insights):
    found = {name: [] for name in CASES}
    for r in insights:
        found[r.cluster_id].append(f"{r.rule}:{r.severity}:{r.affected_entity}")
    wrong = {n: (sorted(found[n]), c["expect"]) for n, c in CASES.items() if sorted(found[n]) != c["expect"]}
    assert not wrong, wrong


def test_texts(insights):
    title = {(r.cluster_id, r.rule): r.title for r in insights}
    assert title["gc_crit", "gc_pressure"] == "High GC pressure on executor 1 (10.0%)"
    assert title["spill_over_input", "memory_spill"] == "Memory spill on stage 1 (1.0 GB)"
    assert title["util_warn", "cluster_utilization"] == "Low cluster utilization (50%, 0 idle executors)"
    assert title["aqe_parts", "config_anti_patterns"] == "Excessive shuffle partitions (200 vs 8 cores)"
    assert title["cache_partial", "caching_issues"] == "Partially cached: RDD 1 (49%)"
    reason = next(r.description for r in insights if r.cluster_id == "failed_other")
    assert reason.endswith("x" * 200 + "...") and "x" * 201 not in reason
    assert all(r.recommendation for r in insights)


def test_one_pass_equals_one_branch_per_rule(plan):
    columns = [*KEY, "rule", "severity", "title", "affected_entity", "metric_value"]
    left, right = (sorted(str(tuple(r)) for r in df.select(*columns).collect()) for df in (plan.insights, plan.insights_by_rule()))
    assert left == right and left


def test_ids_are_unique_and_ranked(plan):
    ids = with_ids(plan.insights).groupBy(*KEY, "insight_id").count().filter("count > 1")
    assert ids.isEmpty()
    ranked = with_rank(plan.insights).filter("cluster_id = 'retry_many'").orderBy("place").collect()
    assert [r.place for r in ranked] == [1, 2, 3]
    assert [r.severity for r in ranked] == ["CRITICAL", "CRITICAL", "WARNING"]


def test_no_python_in_the_plan(plan):
    text = plan.report._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text


def test_scores(plan):
    report = {r.cluster_id: r for r in plan.report.filter(F.col("tick") == TICK).collect()}
    assert report["healthy"].label == "Excellent" and report["healthy"].gc == 100
    assert report["aqe_off"].config == 70 and report["retry_many"].stability == 100 - 2 * 30 - 15
    assert report["gc_crit"].gc == 55


def test_missing_tables_and_no_active_executor(spark):
    rows = [("c", 1, 0, "1", False), ("d", 1, 0, "1", True)]
    executors = spark.createDataFrame(rows, "cluster_id string, tick int, pos bigint, executor_id string, is_active boolean")
    got = {r.cluster_id: r for r in DiagnosticPlan(Telemetry(executors)).report.collect()}
    assert (got["c"].score, got["c"].label, got["c"].color, got["c"].gc) == (0, "N/A", "dim", None)
    assert got["d"].score == 100 and got["d"].insights == 0
