"""Aggregates. Those per key carry every number the key rules, the score and the panels need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions.classify import classify_removal, removal_class_sql
from fleetscope.functions.numbers import jvm_heap_estimate, ratio
from fleetscope.operators.skew import exact_median
from fleetscope.schemas import KEY

DRIVER = "driver"


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


# Conditions of the executor facts. Divisions are ``try_divide``: a filtered aggregate may still evaluate its argument
_WORKER = f"is_active and executor_id <> '{DRIVER}'"
_TIMED = f"{_WORKER} and total_duration_ms > 0"
_READER = f"{_WORKER} and total_shuffle_read > 0"
_ACTIVE_READER = "is_active and total_shuffle_read > 0"
_GC = "try_divide(cast(total_gc_time_ms as double), total_duration_ms)"
_SLOTS = "case when max_tasks > 0 then max_tasks else total_cores end"

EXECUTOR_FACTS = {
    "executor_rows": "count(1)",
    "active_n": "count_if(is_active)",
    "worker_n": f"count_if({_WORKER})",
    "cores": "coalesce(sum(total_cores) filter (where is_active), 0)",
    "active_tasks": "coalesce(sum(active_tasks) filter (where is_active), 0)",
    "slots": f"coalesce(sum({_SLOTS}) filter (where is_active), 0)",
    "idle_n": "count_if(is_active and active_tasks = 0)",
    "completed_tasks": "coalesce(sum(completed_tasks) filter (where is_active), 0)",
    "failed_tasks": "coalesce(sum(failed_tasks) filter (where is_active), 0)",
    "failed_most": "max_by(struct(executor_id, failed_tasks, pos), struct(failed_tasks, -pos)) filter (where is_active)",
    "read_n": f"count_if({_READER})",
    "read_max": f"max(total_shuffle_read) filter (where {_READER})",
    "read_max_executor": f"max_by(executor_id, struct(total_shuffle_read, -pos)) filter (where {_READER})",
    "worker_tasks_mean": f"avg(completed_tasks) filter (where {_READER})",
    "worker_tasks_sd": f"stddev_samp(completed_tasks) filter (where {_READER})",
    "worker_gc_n": f"count_if({_TIMED})",
    "worker_gc_mean": f"round(avg({_GC}) filter (where {_TIMED}), 12)",
    "worker_gc_max": f"max({_GC}) filter (where {_TIMED})",
    "active_gc_max": f"max({_GC}) filter (where is_active and total_duration_ms > 0)",
    "worker_shuffle": f"coalesce(sum(total_shuffle_read + total_shuffle_write) filter (where {_TIMED}), 0)",
    "worker_read_mean": f"avg(total_shuffle_read) filter (where {_READER})",
    "worker_read_sd": f"stddev_samp(total_shuffle_read) filter (where {_READER})",
    "active_read_n": f"count_if({_ACTIVE_READER})",
    "active_read_mean": f"avg(total_shuffle_read) filter (where {_ACTIVE_READER})",
    "active_read_sd": f"stddev_samp(total_shuffle_read) filter (where {_ACTIVE_READER})",
    "worker_memory": f"coalesce(sum(max_memory) filter (where {_WORKER}), 0)",
    "first_worker": f"min_by(struct(executor_id, max_memory, total_cores), pos) filter (where {_WORKER})",
    "driver": "max_by(struct(pos, total_duration_ms, total_gc_time_ms, memory_used, max_memory), pos)"
    f" filter (where is_active and executor_id = '{DRIVER}')",
    "excluded_n": "count_if(is_excluded)",
}
for _name in ("OOM", "CONTAINER_KILLED", "TIMEOUT", "SHUFFLE_FETCH"):
    EXECUTOR_FACTS[f"removed_{_name}"] = f"count_if(removal = '{_name}')"
    EXECUTOR_FACTS[f"removed_{_name}_pos"] = f"min(pos) filter (where removal = '{_name}')"


def executor_facts(executors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row per key from its executor rows; every column merges map-side."""
    removal = f"case when not is_active and remove_reason <> '' then {removal_class_sql('remove_reason')} end as removal"
    return executors.selectExpr("*", removal).groupBy(*keys).agg(*[F.expr(f"{sql} as {n}") for n, sql in EXECUTOR_FACTS.items()])


def read_median(executors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    readers = executors.filter(F.col("is_active") & (F.col("executor_id") != DRIVER) & (F.col("total_shuffle_read") > 0))
    return exact_median(readers, keys, "total_shuffle_read", "read_median")


def sql_median(queries: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Median duration of finished queries, 0 when fewer than two finished."""
    done = queries.filter((F.col("status") != "RUNNING") & (F.col("duration_ms") > 0))
    found = exact_median(done, keys, "duration_ms", "query_median_ms")
    return found.withColumn(
        "query_median_ms", F.when(F.col("query_median_ms_n") >= 2, F.col("query_median_ms")).otherwise(0.0)
    )


STAGE_FACTS = {
    "active_stages": "count_if(status = 'ACTIVE')",
    "pending_stages": "count_if(status = 'PENDING')",
    "failed_stages": "count_if(status = 'FAILED')",
    "active_spill": "coalesce(sum(memory_spill_bytes + disk_spill_bytes) filter (where status = 'ACTIVE'), 0)",
    "shuffle_ratio": "round(avg(try_divide(cast(shuffle_read_bytes + shuffle_write_bytes as double), input_bytes))"
    " filter (where status = 'ACTIVE' and input_bytes > 0), 12)",
    "active_cpu_mean": "round(avg(try_divide(cast(executor_cpu_time_ns as double), executor_run_time_ms * 1000000))"
    " filter (where status = 'ACTIVE' and executor_run_time_ms > 0), 12)",
    "retried_n": "count_if(attempt_id > 0)",
    "retried_warn_n": f"count_if(attempt_id > 0 and attempt_id < {T.RETRY_CRIT_ATTEMPT})",
    "killed_tasks": "sum(num_killed_tasks)",
    "stage_tasks": "sum(num_tasks)",
}


def stage_facts(stages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return stages.groupBy(*keys).agg(*[F.expr(f"{sql} as {n}") for n, sql in STAGE_FACTS.items()])


def job_facts(jobs: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return jobs.groupBy(*keys).agg(
        count_if(F.col("status") == "RUNNING").alias("running_jobs"), F.sum("num_failed_tasks").alias("job_failed_tasks")
    )


def sql_facts(queries: DataFrame, keys: list[str] = KEY) -> DataFrame:
    timed = F.col("duration_ms") > 0
    return queries.groupBy(*keys).agg(
        count_if(timed).alias("timed_queries"),
        F.round(F.avg(F.when(timed, F.col("duration_ms"))) / 1000.0, 9).alias("query_seconds_mean"),
    )


def rdd_facts(rdds: DataFrame, keys: list[str]) -> DataFrame:
    return rdds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cache_n"),
        F.sum("memory_used").alias("cache_bytes"),
        F.sum("disk_used").alias("cache_disk_bytes"),
    )


def kill_reasons(stages: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Killed tasks per key and reason."""
    return (
        stages.select(*keys, F.explode("killed_tasks_summary").alias("reason", "killed"))
        .groupBy(*keys, "reason")
        .agg(F.sum("killed").alias("killed"))
    )


def removal_counts(executors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Removed executors per key and error class."""
    removed = executors.filter(~F.col("is_active") & (F.col("remove_reason") != ""))
    return removed.groupBy(*keys, classify_removal(F.col("remove_reason")).alias("error_class")).agg(
        F.count(F.lit(1)).alias("removed")
    )


def executors_total(executors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """TOTAL row of the executor table, with the plain and the weighted GC mean."""
    jvm = F.col("peak_jvm_heap") + F.col("peak_jvm_off_heap")
    sums = executors.groupBy(*keys).agg(
        count_if(F.col("is_active")).alias("active"),
        F.count(F.lit(1)).alias("executors"),
        *[
            F.sum(c).cast("long").alias(c)
            for c in (
                "total_cores", "active_tasks", "completed_tasks", "failed_tasks", "disk_used", "total_gc_time_ms",
                "total_duration_ms", "total_input_bytes", "total_shuffle_read", "total_shuffle_write", "memory_used", "max_memory",
            )
        ],
        F.sum(jvm).alias("jvm_used"),
        (F.avg(ratio(F.col("total_gc_time_ms"), F.col("total_duration_ms"))) * 100.0).alias("gc_pct_mean"),
    )
    has_jvm = F.col("jvm_used") > 0
    return sums.select(
        "*",
        F.when(has_jvm, F.col("jvm_used")).otherwise(F.col("memory_used")).alias("memory_shown"),
        F.when(has_jvm, jvm_heap_estimate(F.col("max_memory"), F.col("jvm_used")))
        .otherwise(F.col("max_memory"))
        .alias("memory_limit_shown"),
        (ratio(F.col("total_gc_time_ms"), F.col("total_duration_ms")) * 100.0).alias("gc_pct_weighted"),
    )


def efficiency_panel(executors: DataFrame, keys: list[str] = KEY) -> DataFrame:
    sums = executors.groupBy(*keys).agg(
        F.sum("memory_used").alias("memory_used"),
        F.sum("max_memory").alias("max_memory"),
        F.sum("disk_used").alias("disk_used"),
        F.sum("active_tasks").alias("active_tasks"),
        F.sum(F.when(F.col("max_tasks") != 0, F.col("max_tasks")).otherwise(F.col("total_cores"))).alias("slots"),
        F.sum("total_gc_time_ms").alias("gc_ms"),
        F.sum("total_duration_ms").alias("run_ms"),
    )
    return sums.select(
        *keys,
        (ratio(F.col("memory_used"), F.col("max_memory")) * 100.0).alias("memory_pct"),
        "disk_used",
        "active_tasks",
        "slots",
        (ratio(F.col("active_tasks"), F.col("slots")) * 100.0).alias("task_pct"),
        (ratio(F.col("gc_ms"), F.col("run_ms")) * 100.0).alias("gc_pct"),
    )


def coefficient_of_variation(df: DataFrame, keys: list[str], value: Column, out: str = "cov") -> DataFrame:
    """Sample deviation over mean; null with fewer than two values or a mean that is not positive."""
    mean = F.avg(value)
    return df.groupBy(*keys).agg(F.when(mean > 0, F.try_divide(F.stddev_samp(value), mean)).alias(out), F.count(value).alias("points"))


# ---------------------------------------------------------------- from raw tasks

TASK_SUMMARY_METRICS = {
    "executor_run_time": "executor_run_time_ms",
    "jvm_gc_time": "jvm_gc_time_ms",
    "memory_bytes_spilled": "memory_bytes_spilled",
    "disk_bytes_spilled": "disk_bytes_spilled",
    "shuffle_read_bytes": "shuffle_read_bytes",
    "input_bytes": "input_bytes",
}


def stage_rollup(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stage counters from raw tasks."""
    keys = [*KEY, "stage_id"] if keys is None else keys
    m = F.col("metrics")
    state = {"num_active_tasks": "RUNNING", "num_complete_tasks": "SUCCESS", "num_failed_tasks": "FAILED", "num_killed_tasks": "KILLED"}
    sums = {
        "input_bytes": "input_bytes", "output_bytes": "output_bytes", "shuffle_read_bytes": "shuffle_read_bytes",
        "shuffle_write_bytes": "shuffle_write_bytes", "executor_run_time_ms": "executor_run_time_ms",
        "executor_cpu_time_ns": "executor_cpu_time_ns", "memory_spill_bytes": "memory_bytes_spilled",
        "disk_spill_bytes": "disk_bytes_spilled", "jvm_gc_time_ms": "jvm_gc_time_ms",
    }
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_tasks"),
        *[count_if(F.col("status") == s).alias(name) for name, s in state.items()],
        *[F.sum(m[src]).alias(name) for name, src in sums.items()],
        F.min("launch_time").alias("submission_time"),
    )


def executor_rollup(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Executor counters from raw tasks."""
    keys = [*KEY, "executor_id"] if keys is None else keys
    m = F.col("metrics")
    return tasks.groupBy(*keys).agg(
        count_if(F.col("status") == "RUNNING").alias("active_tasks"),
        count_if(F.col("status") == "SUCCESS").alias("completed_tasks"),
        count_if(F.col("status") == "FAILED").alias("failed_tasks"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.sum(m["jvm_gc_time_ms"]).alias("total_gc_time_ms"),
        F.sum(m["input_bytes"]).alias("total_input_bytes"),
        F.sum(m["shuffle_read_bytes"]).alias("total_shuffle_read"),
        F.sum(m["shuffle_write_bytes"]).alias("total_shuffle_write"),
    )
