"""Reports, panels, filters, orders and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.catalog.oracle_base import CTES, cut, dv, error_class, fb, fd, fx, removal_class
from fleetscope.catalog.registry import query, r6
from fleetscope.functions import classify, numbers
from fleetscope.lineage import keep
from fleetscope.operators import rollups, tables
from fleetscope.plans import reports
from fleetscope.schemas import CLUSTERS, EXECUTORS, JOBS, KEY, RDDS, SQL_QUERIES, STAGES, conform

AS_OF = "2002-01-01 06:00:00"
AS_OF_SQL = f"timestamp '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def executors(v):
    return conform(v.executors, EXECUTORS)


def stages(v):
    return conform(v.stages, STAGES)


def jobs(v):
    return conform(v.jobs, JOBS)


def sqls(v):
    return conform(v.sql_queries, SQL_QUERIES)


def rdds(v):
    return conform(v.rdds, RDDS)


def clusters(v):
    return conform(v.clusters.withColumn("state", F.lit("RUNNING")).withColumn("start_time", F.lit("2001-12-30 01:02:03").cast("timestamp")), CLUSTERS)


# ---------------------------------------------------------------- projections


@query(
    "executor_ratios",
    f"select cluster_id, tick, executor_id, executor_id='driver' is_driver, round(gc,6) gc_ratio, round({dv('memory_used', 'max_memory')}*100,6) memory_used_pct from x_exec",
)
def executor_ratios(v):
    return executors(v).select(
        *KEY, "executor_id", (F.col("executor_id") == "driver").alias("is_driver"),
        F.round(numbers.ratio(F.col("total_gc_time_ms"), F.col("total_duration_ms")), 6).alias("gc_ratio"),
        F.round(numbers.ratio(F.col("memory_used"), F.col("max_memory")) * 100.0, 6).alias("memory_used_pct"),
    )


@query("stage_spill", "select cluster_id, tick, stage_id, mem_spill+disk_spill spill_bytes from tv_stages")
def stage_spill(v):
    return stages(v).select(*KEY, "stage_id", (F.col("memory_spill_bytes") + F.col("disk_spill_bytes")).alias("spill_bytes"))


@query(
    "task_flags",
    f"select cluster_id, tick, stage_id, task_id, round({dv('gc_ms', 'duration_ms')},6) gc_ratio, mem_spill>0 or disk_spill>0 has_spill from tv_tasks",
)
def task_flags(v):
    m = "metrics."
    return v.tasks.select(
        *KEY, "stage_id", "task_id",
        F.round(numbers.ratio(F.col(m + "jvm_gc_time_ms"), F.col(m + "executor_run_time_ms")), 6).alias("gc_ratio"),
        ((F.col(m + "memory_bytes_spilled") > 0) | (F.col(m + "disk_bytes_spilled") > 0)).alias("has_spill"),
    )


@query("rdd_fraction", f"select cluster_id, rdd_id, round({dv('num_cached', 'num_partitions')},6) fraction_cached from tv_rdds")
def rdd_fraction(v):
    return rdds(v).select(
        "cluster_id", "rdd_id", F.round(numbers.ratio(F.col("num_cached_partitions"), F.col("num_partitions")), 6).alias("fraction_cached")
    )


@query(
    "jobs_report",
    f"""select cluster_id, tick, job_id, {cut('name', 50)} name_display, status, concat(num_completed,'/',num_tasks) progress,
 concat(num_completed_stages+num_active_stages,'/',num_stages) stages, el elapsed_ms, {fd('el')} duration,
 case when cast(submission_time as date)=cast({AS_OF_SQL} as date) then strftime(submission_time,'%H:%M:%S') else strftime(submission_time,'%b %d %H:%M') end submitted
 from (select *, cast(epoch_ms(coalesce(completion_time, {AS_OF_SQL}))-epoch_ms(submission_time) as bigint) el from tv_jobs) j""",
)
def jobs_report(v):
    return reports.jobs_report(jobs(v), as_of()).select(
        *KEY, "job_id", "name_display", "status", "progress", "stages", "elapsed_ms", "duration", "submitted"
    )


@query(
    "stages_report",
    f"""select cluster_id, tick, stage_id, {cut('name', 40)} name_display, status, concat(num_complete,'/',num_tasks) tasks,
 {fb('input_bytes')} input_display, {fb('shuffle_read')} shuffle_read_display, {fb('shuffle_write')} shuffle_write_display,
 {fb('shuffle_write//2')} output_display, {fb('(mem_spill+disk_spill)')} spill_display, {fd('run_ms')} duration,
 cast(epoch_ms({AS_OF_SQL})-epoch_ms(submission_time) as bigint) wall_ms, strftime(submission_time,'%b %d %H:%M') submitted from tv_stages""",
)
def stages_report(v):
    return reports.stages_report(stages(v), as_of()).select(
        *KEY, "stage_id", "name_display", "status", "tasks", "input_display", "shuffle_read_display", "shuffle_write_display",
        "output_display", "spill_display", "duration", "wall_ms", "submitted",
    )


_JVMMAX = "greatest(cast(trunc(max_memory/0.3::double) as bigint), peak_jvm_heap)"
CTES["r_exec"] = f"""
select *, case when is_active and is_excluded then 'Excluded' when is_active then 'Active' else 'Dead' end status, gc*100 gc_pct,
 case when peak_jvm_heap>0 and max_memory>0 then cast(peak_jvm_heap as double)/{_JVMMAX}*100 else {dv('memory_used', 'max_memory')}*100 end memory_pct,
 case when peak_jvm_heap>0 and max_memory>0 then concat({fx('peak_jvm_heap/1073741824.0::double', 1)},'/',{fx(_JVMMAX + '/1073741824.0::double', 1)},'G')
  when memory_used>0 and max_memory>0 then concat({fx('memory_used/1073741824.0::double', 1)},'/',{fx('max_memory/1073741824.0::double', 1)},'G') else '--' end memory_display
from x_exec"""


@query(
    "executors_report",
    f"""select cluster_id, tick, executor_id, status, {cut('host_port', 20)} host_display, round(memory_pct,6) memory_pct, memory_display, round(gc_pct,6) gc_pct,
 case when gc_pct>10 then 'high' when gc_pct>5 then 'elevated' else 'normal' end gc_band, {fb('disk_used')} disk_display,
 {fb('total_shuffle_read')} shuffle_read_display, {fd('total_duration_ms')} duration,
 {fd(f'cast(epoch_ms({AS_OF_SQL})-epoch_ms(add_time) as bigint)')} uptime from r_exec""",
)
def executors_report(v):
    return reports.executors_report(executors(v), as_of()).select(
        *KEY, "executor_id", "status", "host_display", r6("memory_pct"), "memory_display", r6("gc_pct"), "gc_band", "disk_display",
        "shuffle_read_display", "duration", "uptime",
    )


@query(
    "sql_report",
    f"""select cluster_id, tick, execution_id, {cut('description', 60)} description_display, status,
 case when status='RUNNING' then 'running...' when duration_ms=0 then '--' else {fd('duration_ms')} end duration, running_jobs, success_jobs, failed_jobs from tv_sqls""",
)
def sql_report(v):
    return reports.sql_report(sqls(v)).drop("description", "duration_ms")


@query(
    "storage_report",
    f"""select cluster_id, rdd_id, {cut('name', 40)} name_display, concat(num_cached,'/',num_partitions) partitions, storage_level,
 {fb('memory_used')} memory_display, {fb('disk_used')} disk_display, concat({fx(dv('num_cached', 'num_partitions') + '*100', 1)},'%') cached_pct from tv_rdds""",
)
def storage_report(v):
    return reports.storage_report(rdds(v)).select(
        "cluster_id", "rdd_id", "name_display", "partitions", "storage_level", "memory_display", "disk_display", "cached_pct"
    )


_CONF_PAIRS = [
    ("fs.s3a.access.key", "access_key"), ("spark.memory.fraction", "memory_fraction"), ("spark.memory.storageFraction", "storage_fraction"),
    ("spark.serializer", "serializer"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "aqe_advisory"),
    ("spark.sql.adaptive.coalescePartitions.enabled", "aqe_coalesce"), ("spark.sql.adaptive.enabled", "aqe_enabled"),
    ("spark.sql.adaptive.skewJoin.enabled", "aqe_skew"), ("spark.sql.autoBroadcastJoinThreshold", "broadcast_threshold"),
    ("spark.sql.shuffle.partitions", "shuffle_partitions"), ("spark.sql.warehouse.dir", "warehouse_dir"),
]
CTES["r_conf"] = " union all ".join(f"select cluster_id, '{k}' conf_key, {c} conf_value from tv_conf where {c} is not null" for k, c in _CONF_PAIRS)


@query(
    "cluster_report",
    f"""select c.cluster_id, cluster_name, case when autotermination_minutes>0 then concat(autotermination_minutes,'m') else 'disabled' end auto_terminate,
 concat({fx('total_memory_mb/1024.0', 1)},' GB') memory,
 case when autoscale_min is not null then concat(num_workers,' [',autoscale_min,'-',autoscale_max,']') else cast(num_workers as varchar) end workers,
 '2d 4h 57m 57s' uptime, string_agg(concat(conf_key,' = ',{cut('conf_value', 60)}), chr(10) order by conf_key) conf_text
 from tv_conf c join r_conf r on c.cluster_id=r.cluster_id group by all""",
)
def cluster_report(v):
    return reports.cluster_report(clusters(v), as_of()).select(
        "cluster_id", "cluster_name", "auto_terminate", "memory", "workers", "uptime", F.array_join("conf_lines", "\n").alias("conf_text")
    )


@query("cluster_uptime", f"select cluster_id, cast(epoch({AS_OF_SQL})-epoch(timestamp '2001-12-30 01:02:03') as bigint) uptime_seconds, cast(0 as bigint) before_start from tv_conf")
def cluster_uptime(v):
    now = reports.cluster_report(clusters(v), as_of()).select("cluster_id", "uptime_seconds")
    early = reports.cluster_report(clusters(v), F.lit("2000-01-01").cast("timestamp"))
    return now.join(early.select("cluster_id", F.col("uptime_seconds").alias("before_start")), "cluster_id")


@query(
    "failed_tasks_report",
    f"""select cluster_id, tick, stage_id, task_id, attempt, executor_id, {fd('duration_ms')} duration, {cut('error_message', 50)} error_display,
 case when mem_spill+disk_spill>0 then {fb('(mem_spill+disk_spill)')} else '--' end spill_display, round({dv('gc_ms', 'duration_ms')}*100,6) gc_pct,
 case when {dv('gc_ms', 'duration_ms')}*100>10 then 'high' when {dv('gc_ms', 'duration_ms')}*100>5 then 'elevated' else 'normal' end gc_band
 from tv_tasks where status='FAILED'""",
)
def failed_tasks_report(v):
    return reports.failed_tasks_report(v.tasks).withColumn("gc_pct", F.round("gc_pct", 6)).orderBy(*KEY, F.desc("attempt"), "task_id")


@query(
    "event_severity",
    """select cluster_id, pos, event_type, case when event_type in ('SPARK_EXCEPTION','DRIVER_NOT_RESPONDING','NODES_LOST','TERMINATING') then 'error'
 when event_type in ('UPSIZE_COMPLETED','DOWNSCALED','INIT_SCRIPTS_FINISHED') then 'warning' else 'normal' end severity from tv_cluster_events""",
)
def event_severity(v):
    return v.view("cluster_events").select("cluster_id", "pos", "event_type", classify.event_severity(F.col("event_type")).alias("severity"))


# ---------------------------------------------------------------- filters and orders


@query(
    "text_filter",
    "select cluster_id, tick, job_id, status from tv_jobs where contains(lower(name),'1-urgent') or contains(lower(status),'1-urgent')",
)
def text_filter(v):
    return tables.text_filter(jobs(v), " 1-URGENT ", ["name", "status"]).select(*KEY, "job_id", "status")


@query("failures_only", "select cluster_id, tick, job_id, status from tv_jobs where status='FAILED' or num_failed>0")
def failures_only(v):
    return tables.failures_only(jobs(v)).select(*KEY, "job_id", "status")


@query("status_filter", "select cluster_id, tick, stage_id, name from tv_stages where status='ACTIVE'")
def status_filter(v):
    return tables.status_filter(stages(v), "active").select(*KEY, "stage_id", "name")


@query(
    "redact_conf",
    "select cluster_id, conf_key, conf_value from r_conf where conf_key<>'fs.s3a.access.key'",
)
def redact_conf(v):
    return clusters(v).select("cluster_id", F.explode(classify.redact_conf(F.col("spark_conf"))).alias("conf_key", "conf_value"))


_PINNED = "row_number() over (partition by cluster_id, tick order by case when status='RUNNING' then 0 else 1 end, num_completed desc, job_id)"


@query("pinned_sort", f"select cluster_id, tick, job_id, status, {_PINNED} place from tv_jobs")
def pinned_sort(v):
    from fleetscope.operators.skew import dense_number

    order = tables.pinned_order("jobs", "num_completed_tasks", True, F.col("status") == "RUNNING")
    return dense_number(jobs(v), KEY, [*order, F.col("job_id").asc()], None, "place").select(*KEY, "job_id", "status", "place")


@query(
    "executor_order",
    "select cluster_id, tick, executor_id, row_number() over (partition by cluster_id, tick order by case when executor_id='driver' then 0 when is_active then 1 else 2 end, memory_used desc, pos) place from tv_execs",
)
def executor_order(v):
    from fleetscope.operators.skew import dense_number

    order = tables.executor_order("memory_used", descending=True)
    return dense_number(executors(v), KEY, [*order, F.col("pos").asc()], None, "place").select(*KEY, "executor_id", "place")


@query(
    "latest_events",
    "select cluster_id, event_type, message, place from (select *, row_number() over (partition by cluster_id order by event_ts desc, pos desc) place from tv_cluster_events) e where place<=20",
)
def latest_events(v):
    from fleetscope import thresholds as T

    return tables.newest(v.view("cluster_events"), ["cluster_id"], "event_ts", T.EVENTS_SHOWN).select("cluster_id", "event_type", "message", "place")


@query(
    "failed_items_drill",
    """select q.cluster_id, q.tick, q.execution_id, j.job_id, s.stage_id, s.failure_reason
 from (select cluster_id, tick, execution_id, execution_id job_id from tv_sqls where failed_jobs>0 union all select cluster_id, tick, execution_id, execution_id+1 from tv_sqls where failed_jobs>0) q
 join tv_jobs j on q.cluster_id=j.cluster_id and q.tick=j.tick and q.job_id=j.job_id and j.status='FAILED'
 join tv_stages s on j.cluster_id=s.cluster_id and j.tick=s.tick and j.stage_ref=s.stage_id and s.status='FAILED'""",
)
def failed_items_drill(v):
    failed_jobs, failed_stages = reports.failed_items(sqls(v), jobs(v), stages(v))
    return failed_jobs.select(*KEY, "execution_id", "job_id").join(failed_stages, [*KEY, "job_id"]).select(
        *KEY, "execution_id", "job_id", "stage_id", "failure_reason"
    )


# ---------------------------------------------------------------- aggregates

_TOT = "cast(sum({0}) as bigint) {0}"


@query(
    "executors_total",
    f"""select cluster_id, tick, count_if(is_active) active, count(*) executors, {', '.join(_TOT.format(c) for c in ('total_cores', 'active_tasks', 'completed_tasks', 'failed_tasks', 'disk_used', 'total_shuffle_read', 'total_shuffle_write', 'total_input_bytes'))},
 cast(case when sum(peak_jvm_heap)>0 then sum(peak_jvm_heap) else sum(memory_used) end as bigint) memory_shown,
 cast(case when sum(peak_jvm_heap)>0 then greatest(trunc(cast(sum(max_memory) as double)/0.3::double), sum(peak_jvm_heap)) else sum(max_memory) end as bigint) memory_limit_shown,
 round(avg(gc)*100,6) gc_pct_mean, round(cast(sum(total_gc_time_ms) as double)/sum(total_duration_ms)*100,6) gc_pct_weighted from x_exec group by cluster_id, tick""",
)
def executors_total(v):
    return rollups.executors_total(executors(v)).select(
        *KEY, "active", "executors", "total_cores", "active_tasks", "completed_tasks", "failed_tasks", "disk_used", "total_shuffle_read",
        "total_shuffle_write", "total_input_bytes", "memory_shown", "memory_limit_shown", r6("gc_pct_mean"), r6("gc_pct_weighted"),
    )


@query(
    "efficiency_panel",
    """select cluster_id, tick, round(cast(sum(memory_used) as double)/sum(max_memory)*100,6) memory_pct, cast(sum(disk_used) as bigint) disk_used,
 cast(sum(active_tasks) as bigint) active_tasks, cast(sum(case when max_tasks<>0 then max_tasks else total_cores end) as bigint) slots,
 round(cast(sum(active_tasks) as double)/sum(case when max_tasks<>0 then max_tasks else total_cores end)*100,6) task_pct,
 round(cast(sum(total_gc_time_ms) as double)/sum(total_duration_ms)*100,6) gc_pct from tv_execs group by cluster_id, tick""",
)
def efficiency_panel(v):
    return rollups.efficiency_panel(executors(v)).select(
        *KEY, r6("memory_pct"), "disk_used", "active_tasks", "slots", r6("task_pct"), r6("gc_pct")
    )


@query("storage_summary", "select cluster_id, n cached, cast(bytes as bigint) memory_used, cast(disk as bigint) disk_used from k_rdd")
def storage_summary(v):
    return rollups.rdd_facts(rdds(v), ["cluster_id"]).toDF("cluster_id", "cached", "memory_used", "disk_used")


@query(
    "sql_median",
    "select cluster_id, tick, round(median(duration_ms),6) median_ms from tv_sqls where status<>'RUNNING' and duration_ms>0 group by cluster_id, tick having count(*)>=2 union all"
    " select cluster_id, tick, 0.0 from tv_sqls where status<>'RUNNING' and duration_ms>0 group by cluster_id, tick having count(*)<2",
)
def sql_median(v):
    return rollups.sql_median(sqls(v)).select(*KEY, r6("query_median_ms", "median_ms"))


@query(
    "error_counts",
    "select coalesce(j.cluster_id,s.cluster_id) cluster_id, coalesce(j.tick,s.tick) tick, cast(coalesce(failed_tasks,0) as bigint) failed_tasks, coalesce(failed_stages,0) failed_stages"
    " from k_job j full join k_stage s on j.cluster_id=s.cluster_id and j.tick=s.tick",
)
def error_counts(v):
    return reports.error_counts(jobs(v), stages(v))


@query(
    "kill_reasons",
    "select cluster_id, tick, kill_reason reason, cast(sum(num_killed) as bigint) killed from tv_stages where num_killed>0 group by cluster_id, tick, kill_reason",
)
def kill_reasons(v):
    return rollups.kill_reasons(stages(v))


@query("removal_counts", "select cluster_id, tick, cls error_class, n removed from k_removed")
def removal_counts(v):
    return rollups.removal_counts(executors(v))


_Q = {"executor_run_time": "duration_ms", "jvm_gc_time": "gc_ms", "memory_bytes_spilled": "mem_spill", "disk_bytes_spilled": "disk_spill",
      "shuffle_read_bytes": "shuffle_read", "input_bytes": "input_bytes"}


@query(
    "task_quantiles",
    "select cluster_id, tick, stage_id, "
    + ", ".join(f"round(quantile_cont({c},{q}),6) {n}_q{int(q * 100)}" for n, c in _Q.items() for q in (0, 0.25, 0.5, 0.75, 1))
    + " from tv_tasks group by cluster_id, tick, stage_id",
)
def task_quantiles(v):
    from fleetscope.operators.quantiles import task_quantiles as run

    names = [f"{n}_q{int(q * 100)}" for n in _Q for q in (0, 0.25, 0.5, 0.75, 1)]
    return run(v.tasks, [*KEY, "stage_id"]).select(*KEY, "stage_id", *[r6(n) for n in names])


def _sketch_sql():
    """Counts per scope and metric, and that every quantile keeps the stated rank error."""
    points = "(values (0.0), (0.25), (0.5), (0.75), (1.0)) p(point)"
    scopes = {"cluster": "cluster_id", "fleet": "'all'"}
    return " union all ".join(
        f"select '{scope}' scope_name, {key} cluster_id, '{n}' metric, cast(point as double) point, count({c}) n, true within_error"
        f" from tv_tasks cross join {points} group by 2, 4"
        for scope, key in scopes.items()
        for n, c in _Q.items()
    )


@query("quantile_sketches", _sketch_sql())
def quantile_sketches(v):
    """Stage sketches merged to clusters, cluster sketches merged to the fleet, each quantile against its exact rank."""
    from fleetscope.operators import sketches

    names = list(_Q)
    stages = sketches.sketch(v.tasks, [*KEY, "stage_id"])
    clusters = keep(sketches.merge(stages, ["cluster_id"], names))
    fleet = sketches.merge(clusters.withColumn("cluster_id", F.lit("all")), ["cluster_id"], names)
    counts = keep(sketches.value_counts(v.tasks, ["cluster_id"]))
    everywhere = counts.withColumn("cluster_id", F.lit("all"))
    parts = [
        sketches.rank_errors(sketches.read_quantiles(s, ["cluster_id"]), t, ["cluster_id"]).select(
            F.lit(scope).alias("scope_name"), "cluster_id", "metric", "point", "n", (F.col("error") <= sketches.RANK_ERROR).alias("within_error")
        )
        for scope, s, t in (("cluster", clusters, counts), ("fleet", fleet, everywhere))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stage_rollup",
    "select cluster_id, tick, stage_id, num_tasks, num_active num_active_tasks, num_complete num_complete_tasks, num_failed num_failed_tasks, num_killed num_killed_tasks,"
    " input_bytes, shuffle_read shuffle_read_bytes, shuffle_write shuffle_write_bytes, run_ms executor_run_time_ms, cpu_ns executor_cpu_time_ns,"
    " mem_spill memory_spill_bytes, disk_spill disk_spill_bytes, gc_ms jvm_gc_time_ms from tv_stages",
)
def stage_rollup(v):
    return rollups.stage_rollup(v.tasks).drop("output_bytes", "submission_time")


@query(
    "executor_rollup",
    "select cluster_id, tick, executor_id, active_tasks, completed_tasks, failed_tasks, total_duration_ms, total_gc_time_ms, total_input_bytes, total_shuffle_read, total_shuffle_write from tv_execs",
)
def executor_rollup(v):
    return rollups.executor_rollup(v.tasks)


@query(
    "cov",
    "select cluster_id, tick, round(stddev_samp(total_shuffle_read)/avg(total_shuffle_read),6) cov, count(total_shuffle_read) points from tv_execs where is_active group by cluster_id, tick",
)
def cov(v):
    return rollups.coefficient_of_variation(executors(v).filter("is_active"), KEY, F.col("total_shuffle_read")).select(*KEY, r6("cov"), "points")


_STATES = {"jobs": ("RUNNING", "SUCCEEDED", "FAILED"), "stages": ("ACTIVE", "COMPLETE", "PENDING", "FAILED")}


@query(
    "status_counts",
    " union all ".join(
        f"select '{t}' source, cluster_id, tick, "
        + ", ".join(f"count_if(status='{s}') {s.lower()}" for s in ("RUNNING", "SUCCEEDED", "FAILED", "ACTIVE", "COMPLETE", "PENDING", "COMPLETED"))
        + f", count(*) total from tv_{t} group by cluster_id, tick"
        for t in ("jobs", "stages", "sqls")
    ),
)
def status_counts(v):
    states = ("RUNNING", "SUCCEEDED", "FAILED", "ACTIVE", "COMPLETE", "PENDING", "COMPLETED")
    parts = [reports.status_counts(df, states).withColumn("source", F.lit(n)) for n, df in (("jobs", jobs(v)), ("stages", stages(v)), ("sqls", sqls(v)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "activity_now",
    "select coalesce(j.cluster_id,s.cluster_id) cluster_id, coalesce(j.tick,s.tick) tick, coalesce(running,0) running_jobs, coalesce(active_stages,0) active_stages, coalesce(pending_stages,0) pending_stages"
    " from k_job j full join k_stage s on j.cluster_id=s.cluster_id and j.tick=s.tick",
)
def activity_now(v):
    return reports.activity_now(jobs(v), stages(v))


# ---------------------------------------------------------------- scalar functions over whole tables


@query(
    "format_bytes",
    f"select l_orderkey, l_linenumber, l_partkey, n, {fb('n')} shown from (select *, cast(floor(l_extendedprice*l_extendedprice*l_quantity*(l_partkey%1000)) as bigint) n from lineitem) x",
)
def format_bytes(v):
    from fleetscope.functions.text import format_bytes as shown

    n = F.expr("cast(floor(l_extendedprice*l_extendedprice*l_quantity*(l_partkey%1000)) as bigint) as n")
    return v.view("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n).withColumn("shown", shown("n"))


@query(
    "format_duration",
    f"select l_orderkey, l_linenumber, l_partkey, ms, {fd('ms')} shown from (select *, cast(floor(l_extendedprice) as bigint)*(l_partkey%7000) ms from lineitem) x",
)
def format_duration(v):
    from fleetscope.functions.text import format_duration as shown

    ms = F.expr("cast(floor(l_extendedprice) as bigint)*(l_partkey%7000) as ms")
    return v.view("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ms).withColumn("shown", shown("ms"))


@query(
    "format_timestamp",
    "select event_id, case when cast(ts as date)=date '2024-01-10' then strftime(ts,'%H:%M:%S') else strftime(ts,'%b %d %H:%M') end shown from events",
)
def format_timestamp(v):
    from fleetscope.functions.text import format_timestamp as shown

    return v.view("events").select("event_id", shown(F.col("ts"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).alias("shown"))


CTES["f_bytes"] = """
select p_partkey, p_size, case p_partkey%9 when 0 then 'b' when 1 then 'K' when 2 then 'kb' when 3 then 'm' when 4 then ' MB' when 5 then 'g' when 6 then 'GB' when 7 then '' else 'x' end unit from part"""
_FTEXT = "concat(cast(p_size as string), case when p_partkey%2=0 and unit<>'' then '.5' else '' end, unit)"
_FACTOR = "case lower(trim(unit)) when 'b' then 1 when 'k' then 1024 when 'kb' then 1024 when 'm' then 1048576 when 'mb' then 1048576 when 'g' then 1073741824 when 'gb' then 1073741824 when '' then 1 end"


@query(
    "parse_byte_string",
    f"select p_partkey, {_FTEXT} raw, cast(floor((p_size+case when p_partkey%2=0 and unit<>'' then 0.5 else 0 end)*({_FACTOR})) as bigint) bytes from f_bytes",
)
def parse_byte_string(v):
    from fleetscope.functions.parsing import parse_byte_string as parse

    raw = v.spark.sql(f"select p_partkey, {_FTEXT} raw from ({CTES['f_bytes'].replace('from part', 'from {part}')})", part=v.view("part"))
    return raw.withColumn("bytes", parse(F.col("raw")))


_TS_TEXT = (
    "case event_id%4 when 0 then concat(substr(cast(ts as string),1,10),'T',substr(cast(ts as string),12,8),'.250GMT')"
    " when 1 then concat(substr(cast(ts as string),1,10),'T',substr(cast(ts as string),12,8),'.250+0200') when 2 then cast(1704067200000+event_id*1000 as string) else 'yesterday' end"
)
_TS_MS = "cast(epoch_ms(date_trunc('second', ts)) as bigint)+250"


@query(
    "parse_spark_ts",
    f"select event_id, case event_id%4 when 0 then {_TS_MS} when 1 then {_TS_MS}-7200000 when 2 then 1704067200000+event_id*1000 end ms from events",
)
def parse_spark_ts(v):
    from fleetscope.functions.parsing import parse_spark_ts as parse

    return v.view("events").select("event_id", F.unix_millis(parse(F.expr(_TS_TEXT))).alias("ms"))


@query("epoch_ms", "select event_id, case when event_id%5<>0 then 1704067200000+event_id*1000 end ms from events")
def epoch_ms(v):
    from fleetscope.functions.parsing import epoch_ms as parse

    raw = F.expr("case event_id%10 when 0 then 0 when 5 then cast(null as bigint) else 1704067200000+event_id*1000 end")
    return v.view("events").select("event_id", F.unix_millis(parse(raw)).alias("ms"))


_INT_TEXT = "case p_partkey%4 when 0 then cast(p_partkey as string) when 1 then concat(' -', cast(p_size as string)) when 2 then 'n/a' else '3.5' end"


@query("safe_int", "select p_partkey, case p_partkey%4 when 0 then p_partkey when 1 then -p_size else 0 end n from part")
def safe_int(v):
    from fleetscope.functions.parsing import safe_int as parse

    return v.view("part").select("p_partkey", parse(F.expr(_INT_TEXT)).alias("n"))


@query("enum_coerce", "select event_id, case when event_type in ('error','click') then upper(event_type) else 'UNKNOWN' end state from events")
def enum_coerce(v):
    from fleetscope.functions.parsing import coerce_enum

    return v.view("events").select("event_id", coerce_enum(F.col("event_type"), ("ERROR", "CLICK"), "UNKNOWN").alias("state"))


@query("classify_error", f"select task_id, {error_class('error_message')} error_class from tv_tasks")
def classify_error(v):
    return v.tasks.select("task_id", classify.classify_error(F.col("error_message")).alias("error_class"))


@query("classify_removal", f"select task_id, {removal_class('error_message')} removal_class from tv_tasks")
def classify_removal(v):
    return v.tasks.select("task_id", classify.classify_removal(F.col("error_message")).alias("removal_class"))


@query(
    "is_skewed",
    "select cluster_id, tick, stage_id, case when p50<=0 then mx>0 else mx/p50>=10 end skewed"
    " from (select cluster_id, tick, stage_id, quantile_cont(duration_ms,0.5) p50, max(duration_ms) mx from tv_tasks group by cluster_id, tick, stage_id) q",
)
def is_skewed(v):
    from fleetscope.operators.quantiles import task_quantiles as run

    q = run(v.tasks, [*KEY, "stage_id"], {"run": "executor_run_time_ms"}, (0.5, 1.0))
    return q.select(*KEY, "stage_id", numbers.is_skewed(F.col("run_q50"), F.col("run_q100")).alias("skewed"))


@query("is_gc_pressure", "select task_id, case when duration_ms<=0 then false else cast(gc_ms as double)/duration_ms>=0.1 end pressed from tv_tasks")
def is_gc_pressure(v):
    return v.tasks.select("task_id", numbers.is_gc_pressure(F.col("metrics.jvm_gc_time_ms"), F.col("metrics.executor_run_time_ms")).alias("pressed"))


_SCORE = "cast(floor(value) as int)%101"


@query(
    "score_label",
    f"""select event_id, score, case when score>=90 then 'Excellent' when score>=70 then 'Good' when score>=50 then 'Fair' when score>=30 then 'Poor' else 'Critical' end as label,
 case when score>=90 then 'green' when score>=70 then 'blue' when score>=50 then 'yellow' when score>=30 then '#ff8c00' else 'red' end as color,
 case when score>=70 then 'green' when score>=40 then 'yellow' else 'red' end component_color from (select event_id, {_SCORE} score from events) e""",
)
def score_label(v):
    s = F.col("score")
    return v.view("events").select("event_id", F.expr(f"{_SCORE} as score")).select(
        "event_id", "score", classify.score_label(s).alias("label"), classify.score_colour(s).alias("color"), classify.component_colour(s).alias("component_color")
    )


@query(
    "severity_rank",
    "select cluster_id, tick, category, affected_entity, title, sev severity_rank from i_all",
)
def severity_rank(v):
    from fleetscope.plans.report import DiagnosticPlan

    found = DiagnosticPlan(v.telemetry, store=True).insights
    return found.select(*KEY, "category", "affected_entity", "title", classify.severity_rank(F.col("severity")).alias("severity_rank"))


