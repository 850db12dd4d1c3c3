"""Report tables: jobs, stages, executors, SQL, storage, cluster, failed tasks, and the panels beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions.classify import gc_band
from fleetscope.functions.numbers import memory_pct, ratio
from fleetscope.functions.text import (
    duration_sql,
    ellipsis,
    fixed_sql,
    format_bytes,
    format_duration,
    format_timestamp,
)
from fleetscope.operators import rollups
from fleetscope.schemas import KEY


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def jobs_report(jobs: DataFrame, as_of: Column) -> DataFrame:
    """``elapsed_ms`` runs to completion, or to ``as_of`` while the job has none."""
    took = elapsed_ms(F.col("submission_time"), F.coalesce("completion_time", as_of))
    return jobs.select(
        *KEY, "job_id", "name", ellipsis("name", 50).alias("name_display"), "status",
        F.expr("concat(num_completed_tasks, '/', num_tasks)").alias("progress"),
        F.least(ratio(F.col("num_completed_tasks"), F.col("num_tasks")), F.lit(1.0)).alias("progress_ratio"),
        F.expr("concat(num_completed_stages + num_active_stages, '/', num_stages)").alias("stages"),
        F.coalesce(took, F.lit(0)).alias("elapsed_ms"),
        "num_completed_tasks", "num_failed_tasks", "num_completed_stages", "submission_time",
        format_timestamp(F.col("submission_time"), as_of).alias("submitted"),
    ).withColumn("duration", F.expr(f"case when submission_time is null then '--' else {duration_sql('elapsed_ms')} end"))


def stages_report(stages: DataFrame, as_of: Column) -> DataFrame:
    sizes = {"input_bytes": "input_display", "output_bytes": "output_display", "shuffle_read_bytes": "shuffle_read_display",
             "shuffle_write_bytes": "shuffle_write_display", "spill_bytes": "spill_display"}
    rows = stages.withColumn("spill_bytes", F.expr("memory_spill_bytes + disk_spill_bytes"))
    return rows.select(
        *KEY, "stage_id", "attempt_id", "name", ellipsis("name", 40).alias("name_display"), "status",
        F.expr("concat(num_complete_tasks, '/', num_tasks)").alias("tasks"),
        *sizes, *[format_bytes(c).alias(shown) for c, shown in sizes.items()],
        "executor_run_time_ms", format_duration("executor_run_time_ms").alias("duration"),
        elapsed_ms(F.col("submission_time"), F.coalesce("completion_time", as_of)).alias("wall_ms"),
        "num_complete_tasks", "num_failed_tasks", "submission_time",
        format_timestamp(F.col("submission_time"), as_of).alias("submitted"),
    )


def executors_report(executors: DataFrame, as_of: Column) -> DataFrame:
    gc_pct = ratio(F.col("total_gc_time_ms"), F.col("total_duration_ms")) * 100.0
    jvm = F.col("peak_jvm_heap") + F.col("peak_jvm_off_heap")
    has_jvm = (jvm > 0) & (F.col("max_memory") > 0)
    has_storage = (F.col("memory_used") > 0) & (F.col("max_memory") > 0)
    limit = F.greatest((F.col("max_memory") / T.STORAGE_SHARE_OF_HEAP).cast("long"), jvm)
    gb = lambda c: F.format_string("%.1f", F.bround(c / float(T.GIB), 1))
    return executors.select(
        *KEY, "executor_id", F.expr("executor_id = 'driver'").alias("is_driver"), "is_active", "host_port",
        ellipsis("host_port", 20).alias("host_display"),
        F.expr("case when is_active and is_excluded then 'Excluded' when is_active then 'Active' else 'Dead' end").alias("status"),
        "total_cores", "active_tasks", "completed_tasks", "failed_tasks", "memory_used",
        memory_pct(F.col("peak_jvm_heap"), F.col("peak_jvm_off_heap"), F.col("memory_used"), F.col("max_memory")).alias("memory_pct"),
        F.when(has_jvm, F.concat(gb(jvm), F.lit("/"), gb(limit), F.lit("G")))
        .when(has_storage, F.concat(gb(F.col("memory_used")), F.lit("/"), gb(F.col("max_memory")), F.lit("G")))
        .otherwise("--").alias("memory_display"),
        (gc_pct / 100.0).alias("gc_ratio"), gc_pct.alias("gc_pct"), gc_band(gc_pct).alias("gc_band"),
        "disk_used", format_bytes("disk_used").alias("disk_display"),
        "total_shuffle_read", format_bytes("total_shuffle_read").alias("shuffle_read_display"),
        "total_shuffle_write", format_bytes("total_shuffle_write").alias("shuffle_write_display"),
        "total_duration_ms", format_duration("total_duration_ms").alias("duration"), "add_time",
        elapsed_ms(F.col("add_time"), as_of).alias("uptime_ms"),
    ).withColumn("uptime", format_duration("uptime_ms"))


def sql_report(queries: DataFrame) -> DataFrame:
    rows = queries.withColumn("status", F.expr("case when status is null or status = '' then 'UNKNOWN' else upper(status) end"))
    return rows.select(
        *KEY, "execution_id", "description", ellipsis("description", 60).alias("description_display"), "status", "duration_ms",
        F.expr(
            "case when status = 'RUNNING' then 'running...' when duration_ms is null or duration_ms = 0 then '--'"
            f" else {duration_sql('duration_ms')} end"
        ).alias("duration"),
        "running_jobs", "success_jobs", F.size("failed_job_ids").alias("failed_jobs"),
    )


def storage_report(rdds: DataFrame) -> DataFrame:
    keys = [k for k in KEY if k in rdds.columns]
    rows = rdds.withColumn("fraction_cached", ratio(F.col("num_cached_partitions"), F.col("num_partitions")))
    return rows.select(
        *keys, "rdd_id", "name", ellipsis("name", 40).alias("name_display"), "num_cached_partitions",
        F.expr("concat(num_cached_partitions, '/', num_partitions)").alias("partitions"), "storage_level",
        "memory_used", format_bytes("memory_used").alias("memory_display"),
        "disk_used", format_bytes("disk_used").alias("disk_display"),
        "fraction_cached", F.expr(f"concat({fixed_sql('fraction_cached * 100D', 1)}, '%')").alias("cached_pct"),
    )


def cluster_report(clusters: DataFrame, as_of: Column) -> DataFrame:
    """Identity, resources and the sorted configuration with long values cut."""
    up = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp("start_time"))
    rows = clusters.withColumn("uptime_seconds", F.coalesce(up, F.lit(0)))
    conf = (
        "transform(array_sort(map_entries(spark_conf)), e -> concat(e.key, ' = ',"
        " case when length(e.value) > 60 then concat(substring(e.value, 1, 57), '...') else e.value end))"
    )
    return rows.selectExpr(
        *[k for k in KEY if k in clusters.columns], "cluster_name", "state",
        "case when spark_version = '' then '--' else spark_version end as spark_version",
        "case when runtime_engine = '' then 'Standard' else runtime_engine end as runtime",
        "case when data_security_mode = '' then '--' else data_security_mode end as security",
        "case when autotermination_minutes > 0 then concat(autotermination_minutes, 'm') else 'disabled' end as auto_terminate",
        f"concat({fixed_sql('total_memory_mb / 1024', 1)}, ' GB') as memory",
        "case when autoscale_min is not null and autoscale_max is not null"
        " then concat(num_workers, ' [', autoscale_min, '-', autoscale_max, ']') else cast(num_workers as string) end as workers",
        "uptime_seconds",
        f"case when uptime_seconds = 0 then '--' else {duration_sql('uptime_seconds * 1000')} end as uptime",
        f"{conf} as conf_lines",
    )


def failed_tasks_report(tasks: DataFrame) -> DataFrame:
    """Failed tasks with their error on one line. Sort by attempt, newest first, for display."""
    failed = tasks.filter(F.col("status") == "FAILED").withColumns(
        {
            "error": F.coalesce("error_message", F.lit("")),
            "spill_bytes": F.expr("metrics.memory_bytes_spilled + metrics.disk_bytes_spilled"),
            "gc_pct": ratio(F.col("metrics.jvm_gc_time_ms"), F.col("metrics.executor_run_time_ms")) * 100.0,
        }
    )
    return failed.select(
        *KEY, "stage_id", "task_id", "attempt", "executor_id", format_duration("duration_ms").alias("duration"),
        F.regexp_replace(ellipsis("error", 50), "\n", " ").alias("error_display"),
        F.when(F.col("spill_bytes") > 0, format_bytes("spill_bytes")).otherwise("--").alias("spill_display"),
        F.col("gc_pct"), gc_band(F.col("gc_pct")).alias("gc_band"),
    )


# ---------------------------------------------------------------- panels


def error_counts(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Failed tasks over jobs, and failed stages, per key."""
    failed_tasks = jobs.groupBy(*KEY).agg(F.sum("num_failed_tasks").alias("failed_tasks"))
    failed_stages = stages.groupBy(*KEY).agg(F.count_if(F.col("status") == "FAILED").alias("failed_stages"))
    return failed_tasks.join(failed_stages, KEY, "full").na.fill(0, ["failed_tasks", "failed_stages"])


def status_counts(df: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Rows per state and key, one column per state, plus the total."""
    return df.groupBy(*KEY).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in states], F.count(F.lit(1)).alias("total")
    )


def activity_now(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    running = rollups.job_facts(jobs).select(*KEY, "running_jobs")
    states = rollups.stage_facts(stages).select(*KEY, "active_stages", "pending_stages")
    return running.join(states, KEY, "full").na.fill(0, ["running_jobs", "active_stages", "pending_stages"])


def activity_points(executors: DataFrame) -> DataFrame:
    """One point per poll: active tasks, active executors, GC share, memory share."""
    return executors.groupBy(*KEY).agg(
        F.sum("active_tasks").alias("active_tasks"),
        F.count_if(F.col("is_active")).alias("executor_count"),
        F.sum("total_gc_time_ms").alias("gc_ms"),
        F.sum("total_duration_ms").alias("run_ms"),
        F.sum("memory_used").alias("used"),
        F.sum("max_memory").alias("limit"),
    ).select(
        *KEY, "active_tasks", "executor_count",
        F.when(F.col("run_ms") > 0, F.try_divide("gc_ms", "run_ms") * 100.0).alias("gc_pct"),
        F.when(F.col("limit") > 0, F.try_divide("used", "limit") * 100.0).alias("memory_pct"),
    )


NODE = "struct<nodeName:string,metrics:array<struct<name:string,value:string>>,children:array<string>>"
#: Units of metric texts, as what one of them counts (bytes, milliseconds)
UNITS = {
    "B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "PiB": 1 << 50, "EiB": 1 << 60,
    "ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000,
}


def plan_nodes(plan: Column) -> Column:
    """All nodes of a plan document, whatever their depth: ``array<struct<nodeName, metrics>>``, level by level.

    Each step reads one level and keeps the texts of its children for the next; a plan has no more levels than nodes.
    """
    empty = F.from_json(F.lit("[]"), f"array<{NODE}>")
    first = F.struct(F.array(plan).alias("ahead"), empty.alias("nodes"))

    def step(state: Column, _: Column) -> Column:
        level = F.filter(F.transform(state["ahead"], lambda text: F.from_json(text, NODE)), lambda n: n.isNotNull())
        children = F.flatten(F.transform(level, lambda n: F.coalesce(n["children"], F.array().cast("array<string>"))))
        return F.when(F.size(state["ahead"]) == 0, state).otherwise(F.struct(children.alias("ahead"), F.concat(state["nodes"], level).alias("nodes")))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(plan, F.lit('"nodeName"'))))
    return F.aggregate(steps, first, step, lambda s: s["nodes"])


def metric_value(text: Column) -> Column:
    """The total of a metric text: ``1,234``, ``10.5 MiB``, or the first figure of the last line of ``total (min, med, max ...)``.

    Sizes are in bytes, times in milliseconds, rounded; null if there is no figure.
    """
    last = F.element_at(F.split(F.trim(text), "\n"), -1)
    number = F.regexp_replace(F.regexp_extract(last, r"^\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    unit = F.regexp_extract(last, r"^\s*[0-9][0-9,.]*\s*([A-Za-z]+)", 1)
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in (pair[0], float(pair[1]))]), unit), F.lit(1.0))
    return F.when((unit == "") & ~F.contains(number, F.lit(".")), number.try_cast("bigint")).otherwise(F.round(number.try_cast("double") * size).cast("bigint"))


def sql_io(plans: DataFrame) -> DataFrame:
    """Scan bytes, rows scanned and shuffle bytes of each query from its plan document; null where no node tells.

    ``plans``: key, ``execution_id`` and ``plan``, the JSON text of the root node (``nodeName``, ``metrics`` of ``name`` and ``value``,
    nested ``children``). Nodes that only wrap others (stages of generated code, adaptive parts) are passed through.
    """
    nodes = plans.select(*KEY, "execution_id", F.explode_outer(plan_nodes(F.col("plan"))).alias("node"))
    metrics = nodes.select(*KEY, "execution_id", F.col("node.nodeName").alias("node"), F.explode_outer("node.metrics").alias("metric"))
    value, name = metric_value(F.col("metric.value")), F.col("metric.name")
    scan, exchange = F.contains("node", F.lit("Scan")), F.contains("node", F.lit("Exchange"))
    size = name.isin("bytesRead", "size of files read")
    return metrics.groupBy(*KEY, "execution_id").agg(
        F.sum(F.when(scan & size, value)).alias("scan_bytes"),
        F.sum(F.when(scan & F.contains(name, F.lit("output rows")), value)).alias("rows_scanned"),
        F.sum(F.when(exchange & F.contains(name, F.lit("data size")), value)).alias("shuffle_bytes"),
    )


def failed_items(queries: DataFrame, jobs: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drill-down: failed jobs of queries, and failed stages of failed jobs."""
    wanted = queries.select(*KEY, "execution_id", F.explode("failed_job_ids").alias("job_id"))
    failed_jobs = wanted.join(jobs.filter("status = 'FAILED'"), [*KEY, "job_id"])
    touched = failed_jobs.select(*KEY, "job_id", F.explode("stage_ids").alias("stage_id")).distinct()
    failed_stages = touched.join(stages.filter("status = 'FAILED'"), [*KEY, "stage_id"])
    return failed_jobs, failed_stages
