"""Histories over polls, accumulated insights, episodes, runs and comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.catalog.oracle_base import CTES, LIST_ORDER, dv
from fleetscope.catalog.registry import query, r6
from fleetscope.catalog.report_queries import clusters, executors, sqls
from fleetscope.lineage import keep, shared_folder
from fleetscope.operators import series
from fleetscope.operators.throttle import throttle
from fleetscope.plans import history, reports, runs
from fleetscope.plans.recording import RunComparison, record
from fleetscope.plans.report import COMPONENTS, DiagnosticPlan
from fleetscope.schemas import KEY
from fleetscope.sources.run_store import RunStore

PARTITION_OF_ORDER = "partition by cluster_id, slot order by poll_ts, snapshot_id"
W60 = "rows between 59 preceding and current row"

# ---------------------------------------------------------------- series


@query(
    "ring_buffer",
    f"""select cluster_id, slot, snapshot_id, count(*) over w buffered, epoch_us(min(poll_ts) over w) oldest_us, round(sum(value) over w,2) total_value
 from (select * from tv_polls where ok) p window w as ({PARTITION_OF_ORDER} {W60})""",
)
def ring_buffer(v):
    return series.ring_buffer(v.view("polls")).select(
        "cluster_id", "slot", "snapshot_id", "buffered", F.unix_micros(F.col("oldest").cast("timestamp")).alias("oldest_us"), F.round("total_value", 2).alias("total_value")
    )


CTES["w_pts"] = f"""
select cluster_id, tick, executor_id, memory_pct, gc*100 gcp, dense_rank() over (partition by cluster_id order by tick) idx from
 (select *, case when peak_jvm_heap>0 and max_memory>0 then cast(peak_jvm_heap as double)/greatest(cast(trunc(max_memory/0.3::double) as bigint), peak_jvm_heap)*100 else {dv("memory_used", "max_memory")}*100 end memory_pct from x_exec) e"""


def _executor_history(name: str, column: str, sql_column: str) -> None:
    @query(
        name,
        f"select cluster_id, tick, executor_id, array_to_string(list_transform((list(round({sql_column},6)) over w)[-8:], lambda x: printf('%.6f', x)), ';') history from w_pts"
        " window w as (partition by cluster_id, executor_id order by idx range between 59 preceding and current row)",
    )
    def run(v):
        text = F.array_join(F.expr("transform(history, x -> format_string('%.6f', x))"), ";")
        return series.executor_history(keep(executors(v)), column).select(*KEY, "executor_id", text.alias("history"))


_executor_history("executor_mem_history", "memory_pct", "memory_pct")
_executor_history("executor_gc_history", "gc_pct", "gcp")

CTES["w_fleet"] = """
select cluster_id, tick, cast(sum(active_tasks) as bigint) active_tasks, count_if(is_active) executor_count, cast(sum(total_gc_time_ms) as double)/sum(total_duration_ms)*100 gc_pct,
 cast(sum(memory_used) as double)/sum(max_memory)*100 memory_pct from tv_execs group by cluster_id, tick"""


def _fleet_history(name: str, column: str) -> None:
    @query(
        name,
        f"select cluster_id, tick, array_to_string(list_transform((list(round({column},6)) over w)[-20:], lambda x: printf('%.6f', x)), ';') history from w_fleet"
        f" window w as (partition by cluster_id order by tick {W60})",
    )
    def run(v):
        text = F.array_join(F.expr("transform(history, x -> format_string('%.6f', x))"), ";")
        return series.fleet_history(reports.activity_points(executors(v)), column).select(*KEY, text.alias("history"))


_fleet_history("cluster_mem_history", "memory_pct")
_fleet_history("cluster_gc_history", "gc_pct")


@query("activity_series", "select cluster_id, tick, active_tasks, executor_count, round(gc_pct,6) gc_pct, round(memory_pct,6) memory_pct from w_fleet")
def activity_series(v):
    return reports.activity_points(executors(v)).select(*KEY, "active_tasks", "executor_count", r6("gc_pct"), r6("memory_pct"))


@query("executor_count_cov", "select cluster_id, tick, points, round(case when points>=3 and mean>0 then sd/mean end,6) cov from k_count")
def executor_count_cov(v):
    p = DiagnosticPlan(v.telemetry)
    cov = F.when((F.col("count_points") >= T.COUNT_COV_MIN_POINTS) & (F.col("count_mean") > 0), F.col("count_sd") / F.col("count_mean"))
    return p.count_history.select(*KEY, F.col("count_points").alias("points"), F.round(cov, 6).alias("cov"))


_AGE = "row_number() over (partition by cluster_id order by tick desc)"


@query("executor_count_history", f"select * from (select cluster_id, tick, executor_count, {_AGE} age from w_fleet) x where age<=2000")
def executor_count_history(v):
    return series.newest_points(reports.activity_points(executors(v)), "executor_count")


@query("health_history", f"select * from (select cluster_id, tick, score, {_AGE} age from h_score) x where age<=2000")
def health_history(v):
    return series.newest_points(plan(v).health, "score")


@query("history_cap", f"select * from (select cluster_id, tick, executor_count, {_AGE} age from w_fleet) x where age<=5")
def history_cap(v):
    return series.newest_points(reports.activity_points(executors(v)), "executor_count", cap=5)


@query("first_worker", "select cluster_id, tick, executor_id, max_memory, total_cores from k_first")
def first_worker(v):
    return series.first_worker(executors(v))


@query(
    "state_transition",
    """select cluster_id, snapshot_id, state, prev previous_state, state in ('TERMINATED','ERROR') spark_unavailable,
 state='RUNNING' and (prev is null or prev in ('TERMINATED','PENDING')) rediscover
 from (select *, lag(state) over (partition by cluster_id order by poll_ts, snapshot_id) prev from tv_cluster_polls) p where prev is distinct from state""",
)
def state_transition(v):
    return series.state_changes(v.view("cluster_polls")).select("cluster_id", "snapshot_id", "state", "previous_state", "spark_unavailable", "rediscover")


@query(
    "context_change",
    """select cluster_id, snapshot_id, prev previous_id, spark_context_id from
 (select *, lag(spark_context_id) over (partition by cluster_id order by poll_ts, snapshot_id) prev from tv_cluster_polls where spark_context_id<>'') p where prev<>spark_context_id""",
)
def context_change(v):
    return series.context_changes(v.view("cluster_polls")).select("cluster_id", "snapshot_id", "previous_id", "spark_context_id")


CTES["j_spine"] = """
select s.cluster_id, s.slot, a.at_ts from (select distinct cluster_id, slot from tv_polls) s
join (select distinct cluster_id, poll_ts at_ts from tv_polls where slot='executors' and ok) a on s.cluster_id=a.cluster_id"""


@query(
    "slot_asof",
    """select j.cluster_id, j.slot, epoch_us(j.at_ts) at_us, p.snapshot_id asof_snapshot from j_spine j
 asof left join (select * from tv_polls where ok) p on j.cluster_id=p.cluster_id and j.slot=p.slot and j.at_ts>=p.poll_ts""",
)
def slot_asof(v):
    polls = v.view("polls")
    slots = polls.select("cluster_id", "slot").distinct()
    analyses = polls.filter("slot = 'executors' and ok").select("cluster_id", F.col("poll_ts").alias("at")).distinct()
    found = series.slot_asof(slots.join(analyses, "cluster_id"), polls)
    return found.select("cluster_id", "slot", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "asof_snapshot")


@query(
    "staleness",
    """select cluster_id, slot, errors, round(age,6) age_seconds, not last_ok or age is null or coalesce(age>2*iv,false) stale from
 (select cluster_id, slot, arg_max(ok, (poll_ts, snapshot_id)) last_ok, count_if(not ok) errors,
  (epoch_us(timestamp '2024-01-25 00:00:00')-max(case when ok then epoch_us(poll_ts) end))/1e6 age,
  case when slot in ('executors','spark_jobs','stages') then 7200 else 36000 end iv
  from tv_polls where poll_ts<=timestamp '2024-01-25 00:00:00' group by cluster_id, slot) x""",
)
def staleness(v):
    interval = F.when(F.col("slot").isin("executors", "spark_jobs", "stages"), 7200).otherwise(36000)
    out = series.staleness(v.view("polls"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), interval)
    return out.select("cluster_id", "slot", "errors", r6("age_seconds"), "stale")


@query(
    "throttle",
    """select cluster_id, slot, at_s from (
 with recursive pts as (select distinct cluster_id, slot, epoch_us(poll_ts)//1000000 s from tv_polls where ok),
 kept as (select cluster_id, slot, min(s) at_s from pts group by cluster_id, slot
  union all select k.cluster_id, k.slot, (select min(s) from pts p where p.cluster_id=k.cluster_id and p.slot=k.slot and p.s>=k.at_s+21600) from kept k where k.at_s is not null)
 select * from kept where at_s is not null) z""",
)
def throttled_polls(v):
    good = v.view("polls").filter("ok").withColumn("at_s", F.expr("cast(floor(unix_micros(cast(poll_ts as timestamp))/1000000) as bigint)"))
    return throttle(good, ["cluster_id", "slot"], "at_s", 21600)


@query(
    "report_dedup",
    'select cluster_id, tick, min(pos) first_pos, count(*) "rows" from tv_jobs group by cluster_id, tick',
)
def report_dedup(v):
    reports_seen = v.jobs.select(*KEY, "pos")
    delivered_twice = reports_seen.union(reports_seen)
    # the first row of a key wins: rows are thinned to one per key and position, then to the least position
    once = delivered_twice.dropDuplicates([*KEY, "pos"])
    return once.groupBy(*KEY).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("rows"))


def _node(name: str, metrics: str = "array()", children: str | None = None) -> str:
    below = "" if children is None else f", 'children', array({children})"
    return f"named_struct('nodeName', '{name}', 'metrics', {metrics}{below})"


def _metric(name: str, value: str) -> str:
    return f"named_struct('name', '{name}', 'value', {value})"


_SPREAD = "' KiB (0.0 B, 1.0 KiB, 2.0 KiB (stage 3.0: task 5))'"
_PARQUET = _node("Scan parquet", f"array({_metric('size of files read', 'concat(duration_ms * 400, chr(32), chr(66))')}, {_metric('number of output rows', 'format_number(duration_ms, 0)')})")
_ORC = _node("FileScan orc", f"array({_metric('bytesRead', 'cast(duration_ms * 600 as string)')}, {_metric('scan time', '(chr(55))')})")
_SHUFFLE = f"concat('total (min, med, max (stageId: taskId))', chr(10), duration_ms * 7, {_SPREAD})"


@query(
    "sql_io",
    """select cluster_id, tick, execution_id, duration_ms*1000 scan_bytes, duration_ms rows_scanned,
 case when failed_jobs>0 then null else duration_ms*7*1024 end shuffle_bytes from tv_sqls""",
)
def sql_io(v):
    """Plan documents of three to five levels, with sizes, grouped digits and spread texts as metrics."""
    scans = _node("Union", "array()", f"{_node('WholeStageCodegen (1)', 'array()', _PARQUET)}, {_node('ColumnarToRow', 'array()', _ORC)}")
    exchange = _node("Exchange", f"array({_metric('data size', _SHUFFLE)})", scans)
    plain, shuffled = _node("AdaptiveSparkPlan", "array()", scans), _node("AdaptiveSparkPlan", "array()", exchange)
    plan_ = F.expr(f"case when size(failed_job_ids) > 0 then to_json({plain}) else to_json({shuffled}) end")
    return reports.sql_io(sqls(v).select(*KEY, "execution_id", plan_.alias("plan")))


# ---------------------------------------------------------------- accumulated insights


def plan(v) -> DiagnosticPlan:
    """Tables rolled up from tasks and the key facts are read by many branches, so they are kept."""
    return DiagnosticPlan(v.telemetry, store=True)


def report_ticks(p: DiagnosticPlan):
    """Keys of all reports by a light plan, kept since it is read several times."""
    return keep(p.tables.executors.select(*KEY).distinct())


CTES["a_rows"] = f"select *, cast(tick as bigint)*1000000+row_number() over (partition by cluster_id, tick order by {LIST_ORDER}) ord from i_all"


def _acc_sql(source: str, spine: str, group: str) -> str:
    on = " and ".join(f"s.{g}=x.{g}" for g in group.split(", "))
    return f"""
select x.*, (select min(tick) from {spine} s where {on} and s.tick>x.last_seen) resolved_at from
 (select {group}, category, affected_entity, title, min(tick) first_seen, max(tick) last_seen, count(*) occurrence_count, min(sev) peak_rank,
  max(metric_value) peak_metric_value, arg_max(severity, ord) severity, arg_max(metric_value, ord) metric_value, arg_max(threshold_value, ord) threshold_value
  from {source} group by {group}, category, affected_entity, title) x"""


CTES["a_acc"] = _acc_sql("a_rows", "k_spine", "cluster_id")
_PEAK = "case peak_rank when 0 then 'CRITICAL' when 1 then 'WARNING' else 'INFO' end"
_ACC_COLS = "category, affected_entity, title, first_seen, last_seen, resolved_at, occurrence_count"


def accumulated(v):
    p = plan(v)
    return history.accumulate(p.passing, p.key_scope.select(*KEY), ["cluster_id"], standing=p.standing)


@query(
    "accumulate",
    f"select cluster_id, {_ACC_COLS}, severity, {_PEAK} peak_severity, round(metric_value,6) metric_value, round(peak_metric_value,6) peak_metric_value from a_acc",
)
def accumulate(v):
    return accumulated(v).select(
        "cluster_id", *history.TITLE_KEY, "first_seen", "last_seen", "resolved_at", "occurrence_count", "severity", "peak_severity",
        r6("metric_value"), r6("peak_metric_value"),
    )


CTES["a_idx"] = "select cluster_id, tick, row_number() over (partition by cluster_id order by tick) idx from k_spine"
CTES["a_seen"] = """select distinct i.cluster_id, category, affected_entity, title, i.tick, idx from i_all i join a_idx s on i.cluster_id=s.cluster_id and i.tick=s.tick"""
CTES["a_isl"] = "select *, idx-row_number() over (partition by cluster_id, category, affected_entity, title order by idx) grp from a_seen"


@query(
    "insight_episodes",
    """select e.cluster_id, category, affected_entity, title, row_number() over (partition by e.cluster_id, category, affected_entity, title order by e.lo) episode,
 opened, last_tick, n.tick resolved_at, ticks from
 (select cluster_id, category, affected_entity, title, min(idx) lo, max(idx) hi, min(tick) opened, max(tick) last_tick, count(*) ticks from a_isl group by cluster_id, category, affected_entity, title, grp) e
 left join a_idx n on n.cluster_id=e.cluster_id and n.idx=e.hi+1""",
)
def insight_episodes(v):
    p = plan(v)
    return history.episodes(p.passing, report_ticks(p), ["cluster_id"], standing=p.standing)


@query("active_resolved_counts", "select cluster_id, count_if(resolved_at is null) active, count_if(resolved_at is not null) resolved from a_acc group by cluster_id")
def active_resolved_counts(v):
    return history.open_counts(accumulated(v), ["cluster_id"])


_ACC_ORDER = "resolved_at is not null, case when resolved_at is null then peak_rank else -resolved_at end, first_seen, category, affected_entity, title"


@query("accumulated_order", f"select cluster_id, category, affected_entity, title, row_number() over (partition by cluster_id order by {_ACC_ORDER}) place from a_acc")
def accumulated_order(v):
    return history.accumulated_order(accumulated(v), ["cluster_id"]).select("cluster_id", *history.TITLE_KEY, "place")


@query(
    "top_issues",
    f"""select cluster_id, category, title, resolved_at, line, greatest(0, n-case when resolved_at is null then 10 else 5 end) more from
 (select *, row_number() over (partition by cluster_id, resolved_at is null order by {_ACC_ORDER}) line, count(*) over (partition by cluster_id, resolved_at is null) n from a_acc) x
 where line<=case when resolved_at is null then 10 else 5 end""",
)
def top_issues(v):
    return history.top_issues(accumulated(v), ["cluster_id"]).select("cluster_id", "category", "title", "resolved_at", "line", "more")


# ---------------------------------------------------------------- runs

CTES["u_spine"] = "select s.cluster_id, s.tick, r.run_id from k_spine s join tv_runs r on s.cluster_id=r.cluster_id and s.tick between r.start_tick and r.stop_tick"
CTES["u_rows"] = "select a.*, r.run_id from a_rows a join tv_runs r on a.cluster_id=r.cluster_id and a.tick between r.start_tick and r.stop_tick"
CTES["u_acc"] = _acc_sql("u_rows", "u_spine", "cluster_id, run_id")
CTES["u_health"] = "select h.*, u.run_id, (cast(floor(h.tick/10) as bigint)*4+h.tick%10)*13 at_s from h_score h join u_spine u on h.cluster_id=u.cluster_id and h.tick=u.tick"
CTES["u_snap"] = """select h.* from u_health h join (
 with recursive pts as (select distinct run_id, at_s s from u_health),
 walk as (select run_id, min(s) at_s from pts group by run_id
  union all select k.run_id, (select min(s) from pts p where p.run_id=k.run_id and p.s>=k.at_s+30) from walk k where k.at_s is not null)
 select * from walk where at_s is not null) z on h.run_id=z.run_id and h.at_s=z.at_s"""
CTES["u_final"] = "select * from (select *, row_number() over (partition by run_id order by tick desc) last_rn from u_snap) x where last_rn=1"
CTES["u_pairs"] = "select concat('run_a_', cast(r_regionkey as varchar)) run_a, concat('run_b_', cast((r_regionkey+1)%5 as varchar)) run_b from region"
SECONDS = "(cast(floor(tick/10) as bigint)*4 + tick%10)*13"


def started(v):
    return runs.start_runs(v.view("runs"), clusters(v))


def compared(v, *tables: str) -> RunComparison:
    """Runs recorded in a store of their own (only the tables named, and the runs), then read back from it.

    Each cluster's later run against its neighbour's earlier one, named in the wrong order.
    """
    store = record(_empty_store(v), plan(v), started(v), F.expr(SECONDS), ("runs", *tables))
    named = v.view("region").selectExpr("concat('run_b_', cast((r_regionkey+1)%5 as string)) left_run", "concat('run_a_', cast(r_regionkey as string)) right_run")
    return RunComparison(store, named)


def _empty_store(v) -> RunStore:
    return RunStore(v.spark, f"{shared_folder(v.spark)}/runs-{uuid.uuid4().hex}")


def ticks_of(v):
    return v.executors.select(*KEY).distinct()


def exported(v):
    p = plan(v)
    return runs.stop_runs(p.passing, ticks_of(v), v.view("runs"), p.standing)


def kept_snapshots(v):
    return runs.snapshots(plan(v).health, v.view("runs"), F.expr(SECONDS), ticks=ticks_of(v))


@query("run_start", "select r.cluster_id, r.run_id, name, start_tick, stop_tick, count(c.conf_key) conf_size from tv_runs r join r_conf c on r.cluster_id=c.cluster_id where conf_key<>'fs.s3a.access.key' group by all")
def run_start(v):
    return started(v).select("cluster_id", "run_id", "name", "start_tick", "stop_tick", F.size("conf").cast("long").alias("conf_size"))


@query("run_assign", "select cluster_id, tick, run_id from u_spine")
def run_assign(v):
    return runs.assign(v.executors.select(*KEY).distinct(), v.view("runs"))


_EXPORT_SQL = f"select cluster_id, run_id, {_ACC_COLS}, severity, {_PEAK} peak_severity, round(metric_value,6) metric_value, round(peak_metric_value,6) peak_metric_value, round(threshold_value,6) threshold_value from u_acc"


@query("run_stop", _EXPORT_SQL)
def run_stop(v):
    return runs.export_insights(exported(v)).drop("description", "recommendation", "peak_rank").withColumns(
        {c: F.round(c, 6) for c in ("metric_value", "peak_metric_value", "threshold_value")}
    )


@query("insight_export", "select run_id, category, affected_entity, title, severity, occurrence_count from u_acc")
def insight_export(v):
    return runs.export_insights(exported(v)).select("run_id", *history.TITLE_KEY, "severity", "occurrence_count")


@query("run_snapshots", "select cluster_id, run_id, tick, score from u_snap")
def run_snapshots(v):
    return kept_snapshots(v).select("cluster_id", "run_id", "tick", "score")


CTES["u_stats"] = """
select r.cluster_id, r.run_id, name, coalesce(avg_score,0) avg_score, coalesce(worst_score,0) worst_score, coalesce(cycles,0) cycles, coalesce(insights,0) insights
from tv_runs r left join (select run_id, avg(score) avg_score, min(score) worst_score, count(*) cycles from u_health group by run_id) h on r.run_id=h.run_id
left join (select run_id, count(*) insights from u_acc group by run_id) a on r.run_id=a.run_id"""


@query("run_stats", "select cluster_id, run_id, name, round(avg_score,6) avg_score, worst_score, cycles, insights from u_stats")
def run_stats(v):
    p = plan(v)
    acc = runs.stop_runs(p.passing, ticks_of(v), v.view("runs"), p.standing)
    return runs.run_stats(p.health, acc, v.view("runs"), ticks_of(v)).select("cluster_id", "run_id", "name", r6("avg_score"), "worst_score", "cycles", "insights")


@query(
    "compare_runs",
    """select run_a, run_b, coalesce(fa.score,0) health_a, coalesce(fb.score,0) health_b, coalesce(fb.score,0)-coalesce(fa.score,0) health_delta,
 round(sa.avg_score,6) avg_score_a, round(sb.avg_score,6) avg_score_b, sa.worst_score worst_score_a, sb.worst_score worst_score_b
 from u_pairs p left join u_final fa on fa.run_id=run_a left join u_final fb on fb.run_id=run_b join u_stats sa on sa.run_id=run_a join u_stats sb on sb.run_id=run_b""",
)
def compare_runs(v):
    return compared(v, "run_health", "run_snapshots").health.withColumns(
        {"avg_score_a": F.round("avg_score_a", 6), "avg_score_b": F.round("avg_score_b", 6)}
    )


CTES["u_diff"] = """
select coalesce(a.run_a,b.run_a) run_a, coalesce(a.run_b,b.run_b) run_b, coalesce(a.category,b.category) category, coalesce(a.affected_entity,b.affected_entity) affected_entity,
 coalesce(a.title,b.title) title, case when b.title is null then 'resolved' when a.title is null then 'new' else 'persistent' end change,
 coalesce(b.severity,a.severity) severity, b.metric_value-a.metric_value metric_delta, coalesce(a.peak_rank,b.peak_rank) peak_rank, coalesce(a.first_seen,b.first_seen) first_seen
from (select p.run_a, p.run_b, u.* from u_pairs p join u_acc u on u.run_id=p.run_a) a full join (select p.run_a, p.run_b, u.* from u_pairs p join u_acc u on u.run_id=p.run_b) b
 on a.run_a=b.run_a and a.category=b.category and a.affected_entity=b.affected_entity and a.title=b.title"""


@query("insight_diff", "select run_a, run_b, category, affected_entity, title, change, severity, round(metric_delta,6) metric_delta from u_diff")
def insight_diff(v):
    return compared(v, "run_insights").insights.select(
        "run_a", "run_b", *history.TITLE_KEY, "change", "severity", r6("metric_delta")
    )


@query(
    "diff_limits",
    """select run_a, run_b, category, title, change, place, greatest(0,n-10) more from
 (select *, row_number() over (partition by run_a, change order by peak_rank, first_seen, category, affected_entity, title) place, count(*) over (partition by run_a, change) n from u_diff) x where place<=10""",
)
def diff_limits(v):
    return runs.limit_diff(compared(v, "run_insights").insights).select("run_a", "run_b", "category", "title", "change", "place", "more")


@query(
    "component_diff",
    " union all ".join(
        f"select run_a, run_b, '{c}' component, coalesce(a.{c},100) score_a, coalesce(b.{c},100) score_b, coalesce(b.{c},100)-coalesce(a.{c},100) delta"
        " from u_pairs left join u_final a on a.run_id=run_a left join u_final b on b.run_id=run_b"
        for c in COMPONENTS
    ),
)
def component_diff(v):
    return compared(v, "run_snapshots").components


CTES["u_conf"] = "select r.run_id, conf_key, conf_value from tv_runs r join r_conf c on r.cluster_id=c.cluster_id where conf_key<>'fs.s3a.access.key'"
CTES["u_cdiff"] = """
select * from (select coalesce(a.run_a,b.run_a) run_a, coalesce(a.run_b,b.run_b) run_b, coalesce(a.conf_key,b.conf_key) conf_key,
 coalesce(a.conf_value,'(unset)') value_a, coalesce(b.conf_value,'(unset)') value_b
from (select p.run_a, p.run_b, c.* from u_pairs p join u_conf c on c.run_id=p.run_a) a full join (select p.run_a, p.run_b, c.* from u_pairs p join u_conf c on c.run_id=p.run_b) b
 on a.run_a=b.run_a and a.conf_key=b.conf_key) x where value_a<>value_b"""


@query("conf_diff", "select run_a, run_b, conf_key, value_a, value_b from u_cdiff")
def conf_diff(v):
    return compared(v).conf


# ---------------------------------------------------------------- run store


def _stored(v) -> RunStore:
    """A fresh store in the shared folder with every run and the executor counts of its reports."""
    store = _empty_store(v)
    store.save("runs", started(v).withColumn("conf", F.to_json("conf")))
    points = reports.activity_points(executors(v)).select(*KEY, "executor_count", "active_tasks")
    store.save("run_points", runs.assign(points, v.view("runs")))
    return store


CTES["s_points"] = "select u.cluster_id, u.run_id, u.tick, executor_count, active_tasks from u_spine u join w_fleet f on u.cluster_id=f.cluster_id and u.tick=f.tick"


@query("run_sink", "select cluster_id, run_id, tick, executor_count, active_tasks from s_points")
def run_sink(v):
    return _stored(v).scan("run_points").select("cluster_id", "run_id", "tick", "executor_count", "active_tasks")


@query(
    "run_record",
    """select h.cluster_id, h.run_id, h.tick, score, executor_count, (select count(*) from u_acc a where a.run_id=h.run_id) insights,
 h.tick in (select tick from u_snap s where s.run_id=h.run_id) snapshot from u_health h join w_fleet f on h.cluster_id=f.cluster_id and h.tick=f.tick""",
)
def run_record(v):
    """Whole runs as they are read back: score and executors of each report, whether it is a snapshot, and the run's insights."""
    store = record(_empty_store(v), plan(v), started(v), F.expr(SECONDS))
    found = store.scan("run_insights").groupBy("run_id").agg(F.count("*").alias("insights"))
    kept = store.scan("run_snapshots").select("run_id", "tick", F.lit(True).alias("snapshot"))
    health = store.scan("run_health").join(found, "run_id", "left").join(kept, ["run_id", "tick"], "left").na.fill(0, ["insights"]).na.fill(False, ["snapshot"])
    return health.select("cluster_id", "run_id", "tick", "score", "executor_count", "insights", "snapshot")


@query("run_scan", "select cluster_id, run_id, name, start_tick, row_number() over (order by start_tick desc, run_id) place from tv_runs where cluster_id='c1'")
def run_scan(v):
    rows = _stored(v).runs("c1").select("cluster_id", "run_id", "name", "start_tick")
    from fleetscope.operators.skew import dense_number

    return dense_number(rows, ["cluster_id"], [F.desc("start_tick"), F.col("run_id").asc()], [-F.col("start_tick")], "place")


@query("run_lookup", "select cluster_id, run_id, tick, executor_count, active_tasks from s_points where run_id='run_b_2'")
def run_lookup(v):
    return _stored(v).lookup("run_points", "c2", "run_b_2").select("cluster_id", "run_id", "tick", "executor_count", "active_tasks")


@query(
    "run_delete",
    "select cluster_id, run_id, count(*) points, true existed, false existed_again from s_points where run_id<>'run_a_3' group by cluster_id, run_id",
)
def run_delete(v):
    store = _stored(v)
    existed, again = store.delete("c3", "run_a_3"), store.delete("c3", "run_a_3")
    left = store.compact(["runs", "run_points"]).scan("run_points")
    return left.groupBy("cluster_id", "run_id").agg(F.count(F.lit(1)).alias("points")).withColumns(
        {"existed": F.lit(existed), "existed_again": F.lit(again)}
    )


@query(
    "ring_buffer_stream",
    f"""select cluster_id, slot, snapshot_id, count(*) over w buffered, min(snapshot_id) over w oldest_id
 from (select * from tv_polls where ok) p window w as (partition by cluster_id, slot order by snapshot_id {W60})""",
)
def ring_buffer_stream(v):
    """Batch form of the stream state; the stream itself is compared with it in the tests."""
    from fleetscope.operators import timeline

    good = v.view("polls").filter("ok")
    order = timeline.numbered(good, series.SLOT, ["snapshot_id"], F.floor(F.col("snapshot_id") / 4096))
    frames = {"buffered": F.count("snapshot_id"), "oldest_id": F.min("snapshot_id")}
    return timeline.sliding(order, series.SLOT, "idx", T.RING_SIZE, frames).select("cluster_id", "slot", "snapshot_id", "buffered", "oldest_id")
