"""Independent SQL for the rules, written for DuckDB over the same views.

Statements are kept as named CTEs; ``compose`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

from fleetscope.advice import ADVICE
from fleetscope.sources.sample_views import BASE_TABLES, VIEWS

CTES: dict[str, str] = {}


def _portable(text: str) -> str:
    names = {**{t: t for t in BASE_TABLES}, **{v: f"tv_{v}" for v in VIEWS}}
    return text.format(**names)


for _name, _text in VIEWS.items():
    CTES[f"tv_{_name}"] = _portable(_text)


def compose(statement: str, instead: dict[str, str] | None = None) -> str:
    """``statement`` with the CTEs it refers to, directly or through others, in dependency order.

    ``instead`` replaces or adds some CTEs.
    """
    known = CTES | (instead or {})
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z]+_[a-z0-9_]+\b", sql)):
            if word in known and word not in ordered:
                visit(known[word])
                if word not in ordered:
                    ordered.append(word)

    visit(statement)
    if not ordered:
        return statement
    return "with " + ",\n".join(f"{n} as ({known[n]})" for n in ordered) + "\n" + statement


# ---------------------------------------------------------------- text


def fb(n: str) -> str:
    """Byte text."""
    out = f"case when {n} is null then '--' when {n} < 1024 then concat(cast(trunc({n}) as bigint), ' B')"
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        out += f" when {n} < {1024 ** (power + 1)} then printf('%.1f {unit}', cast(trunc({n}) as double)/{1024**power})"
    return f"({out} else printf('%.1f PB', cast(trunc({n}) as double)/{1024**5}) end)"


def fx(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', cast({x} as double))"


def fd(ms: str) -> str:
    """Duration text."""
    t = f"(({ms})//1000)"
    parts = ",".join(
        [
            f"case when {t}//86400>0 then concat({t}//86400,'d') end",
            f"case when {t}%86400//3600>0 then concat({t}%86400//3600,'h') end",
            f"case when {t}%3600//60>0 then concat({t}%3600//60,'m') end",
            f"case when {t}%60>0 or {t}<60 then concat({t}%60,'s') end",
        ]
    )
    return f"(case when ({ms}) is null then '--' when ({ms})=0 then '0s' else concat_ws(' ',{parts}) end)"


def dv(a: str, b: str) -> str:
    return f"(case when {b} > 0 then cast({a} as double)/{b} else 0.0::double end)"


def cut(text: str, limit: int) -> str:
    return f"(case when length({text})>{limit} then concat(substr({text},1,{limit - 3}),'...') else {text} end)"


def error_class(col: str) -> str:
    """First matching class of an error text."""
    m = lambda p: f"regexp_matches({col}, '(?i){p}')"
    return (
        f"case when {m('OutOfMemoryError|Java heap space')} or {m('GC overhead limit exceeded')} then 'OOM'"
        f" when {m('Container killed by YARN|Container was killed|killed by external signal')}"
        f" or {m('beyond the .* memory limit|exceeding memory limits|Cannot allocate memory')} then 'CONTAINER_KILLED'"
        f" when {m('FetchFailed|shuffle fetch|Failed to connect')} or {m('Connection refused|Connection reset|connection was reset')} then 'SHUFFLE_FETCH'"
        f" when {m('NotSerializableException|InvalidClassException|serializ')} then 'SERIALIZATION'"
        f" when {m('TimeoutException')} or {m('heartbeat.*timed out')} then 'TIMEOUT' else 'UNKNOWN' end"
    )


def removal_class(col: str) -> str:
    m = lambda p: f"regexp_matches({col}, '(?i){p}')"
    return (
        f"case when {m('Container killed by YARN|Container was killed|killed by external signal')} then 'CONTAINER_KILLED'"
        f" when {m('OutOfMemory|memory limit|exceeding memory')} then 'OOM'"
        f" when {m('heartbeat.*timed out|lost|Executor heartbeat')} then 'TIMEOUT'"
        f" when {m('FetchFailed|shuffle')} then 'SHUFFLE_FETCH' else 'UNKNOWN' end"
    )


# ---------------------------------------------------------------- facts

GC = dv("total_gc_time_ms", "total_duration_ms")
SLOTS = "case when max_tasks>0 then max_tasks else total_cores end"
EFF = dv("cpu_ns", "(run_ms*1000000)")

CTES["x_exec"] = f"select *, {GC} gc, is_active and executor_id<>'driver' worker from tv_execs"
CTES["k_spine"] = "select distinct cluster_id, tick from tv_execs"
CTES["k_exec"] = f"""
select cluster_id, tick, count_if(is_active) active_n, count_if(worker) worker_n,
 coalesce(sum(case when is_active then total_cores end),0) cores,
 coalesce(sum(case when is_active then active_tasks end),0) active_tasks,
 coalesce(sum(case when is_active then {SLOTS} end),0) slots,
 count_if(is_active and active_tasks=0) idle_n,
 coalesce(sum(case when is_active then completed_tasks end),0) done, coalesce(sum(case when is_active then failed_tasks end),0) failed,
 count_if(worker and total_shuffle_read>0) read_n,
 median(case when worker and total_shuffle_read>0 then total_shuffle_read end) read_median,
 max(case when worker and total_shuffle_read>0 then total_shuffle_read end) read_max,
 arg_max(executor_id, case when worker and total_shuffle_read>0 then total_shuffle_read*100-pos end) read_max_executor,
 avg(case when worker and total_shuffle_read>0 then completed_tasks end) tasks_mean,
 stddev_samp(case when worker and total_shuffle_read>0 then completed_tasks end) tasks_sd,
 count_if(worker and total_duration_ms>0) gc_n,
 round(avg(case when worker and total_duration_ms>0 then gc end),12) gc_mean,
 max(case when worker and total_duration_ms>0 then gc end) gc_max,
 max(case when is_active and total_duration_ms>0 then gc end) active_gc_max,
 sum(case when worker and total_duration_ms>0 then total_shuffle_read+total_shuffle_write end) worker_shuffle,
 avg(case when worker and total_shuffle_read>0 then total_shuffle_read end) read_mean,
 stddev_samp(case when worker and total_shuffle_read>0 then total_shuffle_read end) read_sd,
 count_if(is_active and total_shuffle_read>0) aread_n,
 avg(case when is_active and total_shuffle_read>0 then total_shuffle_read end) aread_mean,
 stddev_samp(case when is_active and total_shuffle_read>0 then total_shuffle_read end) aread_sd,
 sum(case when worker then max_memory end) worker_memory,
 round(max(case when executor_id='driver' and is_active then gc end),12) driver_gc,
 max(case when executor_id='driver' and is_active then total_duration_ms end) driver_ms,
 max(case when executor_id='driver' and is_active then memory_used end) driver_used,
 max(case when executor_id='driver' and is_active then max_memory end) driver_max,
 count_if(is_excluded) excluded_n
from x_exec group by cluster_id, tick"""
CTES["k_stage"] = f"""
select cluster_id, tick, count_if(status='ACTIVE') active_stages, count_if(status='PENDING') pending_stages,
 count_if(status='FAILED') failed_stages,
 coalesce(sum(case when status='ACTIVE' then mem_spill+disk_spill end),0) spill,
 round(avg(case when status='ACTIVE' and input_bytes>0 then cast(shuffle_read+shuffle_write as double)/input_bytes end),12) shuffle_ratio,
 round(avg(case when status='ACTIVE' and run_ms>0 then {EFF} end),12) cpu_mean,
 count_if(attempt_id>0) retried, count_if(attempt_id in (1,2)) retried_warn, sum(num_killed) killed, sum(num_tasks) tasks
from tv_stages group by cluster_id, tick"""
CTES["k_job"] = """select cluster_id, tick, count_if(status='RUNNING') running, sum(num_failed) failed_tasks from tv_jobs group by cluster_id, tick"""
CTES["k_sql"] = """
select cluster_id, tick, count_if(duration_ms>0) timed, round(avg(case when duration_ms>0 then duration_ms end)/1000.0,9) seconds_mean,
 case when count_if(status<>'RUNNING' and duration_ms>0)>=2 then median(case when status<>'RUNNING' and duration_ms>0 then duration_ms end) else 0 end median_ms
from tv_sqls group by cluster_id, tick"""
CTES["k_rdd"] = "select cluster_id, count(*) n, sum(memory_used) bytes, sum(disk_used) disk from tv_rdds group by cluster_id"
CTES["k_count"] = """
select cluster_id, tick, count(n) over w points, avg(n) over w mean, stddev_samp(n) over w sd
from (select cluster_id, tick, cast(count_if(is_active) as double) n from tv_execs group by cluster_id, tick) c
window w as (partition by cluster_id order by tick rows between 59 preceding and current row)"""
CTES["k_conf"] = "select s.tick, c.* from k_spine s join tv_conf c on s.cluster_id=c.cluster_id"

# ---------------------------------------------------------------- rules


def rule(name: str, det: int, category: str, source: str, branches: list[dict], key: str = "") -> None:
    """CTE ``d_<name>``: one select per branch."""
    selects = []
    for b in branches:
        src = b.get("source", source)
        selects.append(
            f"select {key}cluster_id, {key}tick, {det} det, {b.get('phase', 0)} phase, cast({b.get('pos', '0')} as bigint) pos,"
            f" {b.get('slot', 0)} slot, {'cast(' + b['metric'] + ' as double)' if b.get('ranked') else '0.0::double'} rank_metric,"
            f" '{category}' category, {b['severity']} severity, cast({b['metric']} as double) metric_value,"
            f" cast({b['threshold']} as double) threshold_value, {b.get('entity', repr(''))} affected_entity,"
            f" {b['title']} title, {b['advice']} advice from {src} where {b['when']}"
        )
    CTES[f"d_{name}"] = "\nunion all\n".join(selects)


def lad(x: str, w: float, c: float) -> str:
    return f"case when {x}>={c} then 'CRITICAL' else 'WARNING' end"


def lim(x: str, w: float, c: float) -> str:
    return f"case when {x}>={c} then {c} else {w} end"


W, C, INFO = "'WARNING'", "'CRITICAL'", "'INFO'"
MEASURED = "status in ('ACTIVE','COMPLETE')"
STAGE = "concat('stage_', stage_id)"

rule("gc_pressure", 1, "GC", "x_exec", [
    dict(when="worker and total_duration_ms>0 and gc>=0.05", pos="pos", ranked=True, severity=lad("gc", .05, .1), metric="gc*100",
         threshold="case when gc>=0.1 then 10.0 else 5.0 end", entity="executor_id", advice="'gc_pressure'",
         title=f"concat('High GC pressure on executor ', executor_id, ' (', {fx('gc*100', 1)}, '%)')"),
    dict(source="k_exec", when="worker_n=0 and driver_ms>0 and driver_gc>=0.05", ranked=True, severity=lad("driver_gc", .05, .1), metric="driver_gc*100",
         threshold="case when driver_gc>=0.1 then 10.0 else 5.0 end", entity="'driver'", advice="'gc_pressure'",
         title=f"concat('High GC pressure on executor driver (', {fx('driver_gc*100', 1)}, '%)')"),
])
SPILL_CRIT = "(disk_spill>1073741824 or (input_bytes>0 and cast(mem_spill+disk_spill as double)/input_bytes>1))"
rule("memory_spill", 2, "SPILL", "tv_stages", [
    dict(when=f"{MEASURED} and mem_spill+disk_spill>0", pos="pos", ranked=True, severity=f"case when {SPILL_CRIT} then {C} else {W} end",
         metric="mem_spill+disk_spill", threshold=f"case when disk_spill>1073741824 then 1073741824 when {SPILL_CRIT} then input_bytes else 0 end",
         entity=STAGE, advice="'memory_spill'", title=f"concat('Memory spill on stage ', stage_id, ' (', {fb('(mem_spill+disk_spill)')}, ')')"),
])
rule("data_skew", 3, "SKEW", "k_exec", [
    dict(when="read_n>=2 and read_median>0 and round(read_max/read_median,12)>=3", severity=lad("round(read_max/read_median,12)", 3, 5), metric="round(read_max/read_median,12)",
         threshold=lim("round(read_max/read_median,12)", 3, 5), entity="read_max_executor", advice="'data_skew'",
         title=f"concat('Data skew detected: ', {fx('round(read_max/read_median,12)', 1)}, 'x shuffle read imbalance')"),
    dict(when="read_n>=2 and tasks_mean>0 and round(tasks_sd/tasks_mean,12)>=0.5", slot=1, severity=lad("round(tasks_sd/tasks_mean,12)", .5, 1), metric="round(tasks_sd/tasks_mean,12)",
         threshold=lim("round(tasks_sd/tasks_mean,12)", .5, 1), advice="'task_skew'",
         title=f"concat('Task distribution skew (CoV=', {fx('round(tasks_sd/tasks_mean,12)', 2)}, ')')"),
])
LOAD = "cast(shuffle_read+shuffle_write as double)/input_bytes"
rule("shuffle_bottleneck", 4, "SHUFFLE", "tv_stages", [
    dict(when=f"{MEASURED} and input_bytes>0 and {LOAD}>=0.5", pos="pos", ranked=True, severity=lad(LOAD, .5, 2), metric=LOAD,
         threshold=lim(LOAD, .5, 2.0), entity=STAGE, advice="'shuffle_bottleneck'",
         title=f"concat('Heavy shuffle on stage ', stage_id, ' (', {fx(LOAD, 1)}, 'x input)')"),
])
UTIL = "(cast(e.active_tasks as double)/e.slots*100)"
rule("cluster_utilization", 5, "UTILIZATION", "k_exec e join k_job j on e.cluster_id=j.cluster_id and e.tick=j.tick", [
    dict(when=f"j.running>0 and active_n>0 and slots>0 and {UTIL}<70", severity=f"case when {UTIL}<30 then {C} else {W} end", metric=UTIL,
         threshold=f"case when {UTIL}<30 then 30 else 70 end", advice="'cluster_utilization'",
         title=f"concat('Low cluster utilization (', {fx(UTIL, 0)}, '%, ', idle_n, ' idle executors)')"),
], key="e.")
PART = "(cast(input_bytes as double)/num_tasks)"
ELIG = "status='ACTIVE' and num_tasks>0 and input_bytes>0"
rule("partition_issues", 6, "PARTITION", "tv_stages s join k_exec e on s.cluster_id=e.cluster_id and s.tick=e.tick", [
    dict(when=f"{ELIG} and {PART}>268435456", pos="pos", severity=W, metric=PART, threshold="268435456", entity=STAGE, advice="'partition_large'",
         title=f"concat('Large partitions on stage ', stage_id, ' (', {fb(PART)}, ' avg)')"),
    dict(when=f"{ELIG} and {PART}<1048576", pos="pos", severity=W, metric=PART, threshold="1048576", entity=STAGE, advice="'partition_small'",
         title=f"concat('Tiny partitions on stage ', stage_id, ' (', {fb(PART)}, ' avg, ', num_tasks, ' tasks)')"),
    dict(when=f"{ELIG} and cores>0 and num_tasks<cores", pos="pos", slot=1, severity=W, metric="cast(num_tasks as double)/cores", threshold="1",
         entity=STAGE, advice="'partition_few'", title="concat('Too few partitions on stage ', stage_id, ' (', num_tasks, ' tasks for ', cores, ' cores)')"),
], key="s.")
PROG = "cast(num_complete as double)/num_tasks"
TAIL = "(num_tasks-num_complete<=3 and num_active>0)"
rule("straggler_tasks", 7, "STRAGGLER", "tv_stages", [
    dict(when=f"status='ACTIVE' and num_tasks>0 and {PROG}>0.95 and ({TAIL} or (num_active=1 and num_complete>10))", pos="pos",
         severity=f"case when {TAIL} and num_tasks-num_complete=1 then {C} else {W} end", metric=f"{PROG}*100", threshold="95", entity=STAGE,
         advice="'straggler_tasks'", title="concat('Straggler tasks on stage ', stage_id, ' (', num_tasks-num_complete, ' of ', num_tasks, ' remaining)')"),
])
FAILR = "(cast(failed as double)/(done+failed))"
CTES["k_hot"] = """
select x.cluster_id, x.tick, executor_id, pos, failed_tasks, failed, done, active_n
from x_exec x join k_exec k on x.cluster_id=k.cluster_id and x.tick=k.tick where is_active and failed_tasks > failed*0.5 and failed_tasks>0"""
rule("task_failures", 8, "TASK_FAILURE", "k_exec", [
    dict(when=f"active_n>0 and done+failed>=10 and {FAILR}>=0.01", severity=lad(FAILR, .01, .05), metric=f"{FAILR}*100",
         threshold=f"case when {FAILR}>=0.05 then 5 else 1 end", advice="'task_failures'",
         title=f"concat('Task failure rate ', {fx(FAILR + '*100', 1)}, '% (', failed, '/', done+failed, ' tasks)')"),
    dict(source="k_hot", when="done+failed>=10", phase=1, pos="pos", severity=W, metric="cast(failed_tasks as double)/failed*100", threshold="50",
         entity="executor_id", advice="'failure_hotspot'",
         title=f"concat('Executor ', executor_id, ' has ', {fx('cast(failed_tasks as double)/failed*100', 0)}, '% of all task failures')"),
])
USED, HEAP = "(cast(memory_used as double)/max_memory*100)", "(cast(peak_jvm_heap as double)/max_memory*100)"
rule("memory_pressure", 9, "MEMORY", "x_exec", [
    dict(when=f"is_active and max_memory>0 and {USED}>=80", pos="pos", ranked=True, severity=lad(USED, 80, 95), metric=USED, threshold=lim(USED, 80, 95),
         entity="executor_id", advice="'memory_pressure'", title=f"concat('High memory usage on executor ', executor_id, ' (', {fx(USED, 1)}, '%)')"),
    dict(when=f"is_active and max_memory>0 and {USED}<80 and peak_jvm_heap>0 and {HEAP}>=85", pos="pos", slot=1, ranked=True, severity=lad(HEAP, 85, 95),
         metric=HEAP, threshold=lim(HEAP, 85, 95), entity="executor_id", advice="'memory_pressure'",
         title=f"concat('High peak JVM heap on executor ', executor_id, ' (', {fx(HEAP, 1)}, '%)')"),
])
AQE_ON = "coalesce(aqe_enabled,'true')<>'false'"
rule("aqe_config", 10, "AQE_CONFIG", "k_conf", [
    dict(when="aqe_enabled='false'", severity=C, metric="0", threshold="1", advice="'aqe_off'", title="'AQE is disabled'"),
    dict(when=f"{AQE_ON} and aqe_coalesce='false'", slot=1, severity=W, metric="0", threshold="1", advice="'aqe_coalesce_off'",
         title="'AQE partition coalescing disabled'"),
    dict(when=f"{AQE_ON} and aqe_skew='false'", slot=2, severity=W, metric="0", threshold="1", advice="'aqe_skew_off'",
         title="'AQE skew join optimization disabled'"),
    dict(when=f"{AQE_ON} and aqe_advisory='16MB'", slot=3, severity=INFO, metric="16777216", threshold="33554432", advice="'aqe_advisory_small'",
         title="'AQE advisory partition size is small (16.0 MB)'"),
])
CTES["k_conf_exec"] = """
select c.*, k.cores, k.gc_n, k.gc_mean, k.worker_shuffle, k.active_tasks, k.worker_memory, j.running, q.timed, q.seconds_mean, r.n rdd_n, r.bytes rdd_bytes
from k_conf c join k_exec k on c.cluster_id=k.cluster_id and c.tick=k.tick
left join k_job j on c.cluster_id=j.cluster_id and c.tick=j.tick left join k_sql q on c.cluster_id=q.cluster_id and c.tick=q.tick
left join k_rdd r on c.cluster_id=r.cluster_id"""
rule("serialization", 11, "SERIALIZATION", "k_conf_exec", [
    dict(when="not contains(lower(coalesce(serializer,'java')),'kryo') and gc_n>0 and (gc_mean>=0.05 or worker_shuffle>10737418240)",
         severity=f"case when gc_mean>=0.1 then {C} else {W} end", metric="gc_mean*100", threshold="5", advice="'serialization'",
         title="'Java serialization in use (Kryo recommended)'"),
])
CTES["k_first"] = """
select * from (select *, row_number() over (partition by cluster_id, tick order by pos) rn from x_exec where worker) f where rn=1"""
CORE = "(cast(max_memory as double)/total_cores)"
rule("executor_sizing", 12, "EXECUTOR_SIZING", "k_first", [
    dict(when="max_memory>68719476736", severity=W, metric="max_memory", threshold="68719476736", entity="executor_id", advice="'sizing_heap'",
         title=f"concat('Large executor heap (', {fb('max_memory')}, ')')"),
    dict(when="total_cores>8", slot=1, severity=W, metric="total_cores", threshold="8", entity="executor_id", advice="'sizing_cores'",
         title="concat('High core count per executor (', total_cores, ' cores)')"),
    dict(when=f"total_cores>0 and {CORE}<2147483648", slot=2, severity=W, metric=CORE, threshold="2147483648", entity="executor_id",
         advice="'sizing_per_core'", title=f"concat('Low memory per core (', {fb(CORE)}, '/core)')"),
])
DUSED = "(cast(driver_used as double)/driver_max*100)"
rule("driver_bottleneck", 13, "DRIVER_BOTTLENECK", "k_exec", [
    dict(when="worker_n>0 and gc_n>0 and driver_ms>0 and driver_gc>2*gc_mean and driver_gc>0.05", severity=W, metric="driver_gc*100",
         threshold="gc_mean*2*100", entity="'driver'", advice="'driver_gc'",
         title=f"concat('Driver GC pressure (', {fx('driver_gc*100', 1)}, '% vs ', {fx('gc_mean*100', 1)}, '% avg worker)')"),
    dict(when=f"worker_n>0 and driver_max>0 and {DUSED}>95", slot=1, severity=C, metric=DUSED, threshold="95", entity="'driver'", advice="'driver_memory'",
         title=f"concat('Driver memory critical (', {fx(DUSED, 1)}, '%)')"),
])
PARTS = "coalesce(try_cast(shuffle_partitions as bigint),200)"
MEMF = "coalesce(try_cast(memory_fraction as double),0.6)"
rule("config_anti_patterns", 14, "CONFIG_ANTI_PATTERN", "k_conf_exec", [
    dict(when=f"cores>0 and {PARTS}>10*cores and aqe_coalesce='false'", severity=W, metric=PARTS, threshold="10*cores", advice="'conf_partitions'",
         title=f"concat('Excessive shuffle partitions (', {PARTS}, ' vs ', cores, ' cores)')"),
    dict(when=f"{MEMF}<0.4 or {MEMF}>0.8", slot=1, severity=INFO, metric=MEMF, threshold="0.6", advice="'conf_memory_fraction'",
         title=f"concat('Unusual memory fraction (', {fx(MEMF, 2)}, ')')"),
    dict(when="coalesce(try_cast(storage_fraction as double),0.5)>0.7", slot=2, severity=W, metric="try_cast(storage_fraction as double)", threshold="0.7",
         advice="'conf_storage_fraction'", title=f"concat('High storage fraction (', {fx('try_cast(storage_fraction as double)', 2)}, ')')"),
    dict(when="broadcast_threshold='-1'", slot=3, severity=INFO, metric="-1", threshold="0", advice="'conf_broadcast_off'",
         title="'Auto broadcast join disabled'"),
])
MANY = "(timed>20 and seconds_mean>60)"
rule("photon_opportunity", 15, "PHOTON_OPPORTUNITY", "k_conf_exec", [
    dict(when=f"runtime_engine<>'PHOTON' and ({MANY} or timed>5)", severity=f"case when {MANY} then {W} else {INFO} end", metric="timed", threshold="5",
         advice="'photon_opportunity'", title="concat('Photon runtime may improve SQL performance (', timed, ' queries)')"),
])
rule("io_patterns", 16, "IO_PATTERN", "tv_stages", [
    dict(when=f"{MEASURED} and input_bytes>0 and num_tasks>0 and {PART}<1048576 and num_tasks>100", pos="pos", severity=W, metric=PART,
         threshold="1048576", entity=STAGE, advice="'io_small_files'", title="concat('Small file/partition problem on stage ', stage_id)"),
    dict(when=f"{MEASURED} and input_bytes>0 and num_tasks>0 and run_ms>0 and {EFF}<0.3", pos="pos", slot=1, severity=W, metric=EFF, threshold="0.3",
         entity=STAGE, advice="'io_bound'", title=f"concat('I/O bound stage ', stage_id, ' (CPU efficiency ', {fx(EFF + '*100', 0)}, '%)')"),
])
rule("cpu_io_classification", 17, "CPU_IO_BOUND", "k_stage", [
    dict(when="cpu_mean>0.7", severity=INFO, metric="cpu_mean", threshold="0.7", advice="'cpu_bound_workload'",
         title=f"concat('CPU-bound workload (avg CPU efficiency ', {fx('cpu_mean*100', 0)}, '%)')"),
    dict(when="cpu_mean<0.3", slot=1, severity=INFO, metric="cpu_mean", threshold="0.3", advice="'io_bound_workload'",
         title=f"concat('I/O-bound workload (avg CPU efficiency ', {fx('cpu_mean*100', 0)}, '%)')"),
])
rule("stage_retries", 18, "STAGE_RETRY", "tv_stages", [
    dict(when="attempt_id>0", pos="pos", severity=f"case when attempt_id>=3 then {C} else {W} end", metric="attempt_id", threshold="1", entity=STAGE,
         advice="'stage_retries'", title="concat('Stage ', stage_id, ' retried (attempt ', attempt_id, ')')"),
    dict(source="k_stage", when="retried>1 and retried_warn>0", phase=1, severity=C, metric="retried", threshold="1", advice="'stage_retries_many'",
         title="concat('Multiple stages retried (', retried, ' stages)')"),
])
SLOW = "(s.duration_ms/k.median_ms)"
OUT = f"k.median_ms>0 and s.duration_ms>60000 and {SLOW}"
SQLE = "concat('sql_', execution_id)"
SLOWT = f"concat('SQL query #', execution_id, ' is ', {fx(SLOW, 0)}, 'x slower than median')"
rule("sql_anomalies", 19, "SQL_ANOMALY", "tv_sqls s join k_sql k on s.cluster_id=k.cluster_id and s.tick=k.tick", [
    dict(when="status='RUNNING' and duration_ms>600000", pos="pos", severity=INFO, metric="duration_ms", threshold="600000", entity=SQLE,
         advice="'sql_long'", title=f"concat('Long-running SQL query #', execution_id, ' (', {fx('duration_ms/1000.0', 0)}, 's)')"),
    dict(when=f"{OUT}>=10", pos="pos", slot=1, severity=C, metric=SLOW, threshold="10", entity=SQLE, advice="'sql_outlier_critical'", title=SLOWT),
    dict(when=f"{OUT}>=5 and {SLOW}<10", pos="pos", slot=1, severity=W, metric=SLOW, threshold="5", entity=SQLE, advice="'sql_outlier_warning'", title=SLOWT),
    dict(when="failed_jobs>0", pos="pos", slot=2, severity=W, metric="failed_jobs", threshold="0", entity=SQLE, advice="'sql_failed_jobs'",
         title="concat('SQL query #', execution_id, ' has ', failed_jobs, ' failed job(s)')"),
], key="s.")
rule("join_strategy", 20, "JOIN_STRATEGY", "tv_stages", [
    dict(when=f"{MEASURED} and input_bytes>0 and input_bytes<104857600 and shuffle_read+shuffle_write>5*input_bytes", pos="pos", severity=W, metric=LOAD,
         threshold="5", entity=STAGE, advice="'join_strategy'", title="concat('Possible broadcast join candidate (stage ', stage_id, ')')"),
])
CACHED = dv("num_cached", "num_partitions")
CACHEP = "(cast(rdd_bytes as double)/worker_memory*100)"
rule("caching_issues", 21, "CACHING", "k_spine s join tv_rdds r on s.cluster_id=r.cluster_id", [
    dict(when=f"{CACHED}<0.5", pos="pos", severity=W, metric=CACHED, threshold="0.5", entity="concat('rdd_', rdd_id)", advice="'cache_partial'",
         title=f"concat('Partially cached: ', name, ' (', {fx(CACHED + '*100', 0)}, '%)')"),
    dict(source="k_conf_exec s", when=f"rdd_n>0 and worker_memory>0 and {CACHEP}>60", phase=1, severity=W, metric=CACHEP, threshold="60",
         advice="'cache_memory'", title=f"concat('High cache memory usage (', {fx(CACHEP, 0)}, '% of executor memory)')"),
], key="s.")
IDLE = "(coalesce(running,0)=0 and coalesce(active_tasks,0)=0)"
rule("auto_termination", 22, "AUTO_TERMINATION", "k_conf_exec", [
    dict(when=f"autotermination_minutes=0 and {IDLE}", severity=C, metric="0", threshold="1", advice="'idle_no_timeout'",
         title="'Idle cluster with no auto-termination'"),
    dict(when=f"autotermination_minutes=0 and not {IDLE}", severity=W, metric="0", threshold="1", advice="'no_timeout'", title="'Auto-termination disabled'"),
    dict(when="autotermination_minutes>120", severity=INFO, metric="autotermination_minutes", threshold="120", advice="'long_timeout'",
         title="concat('Long auto-termination timeout (', autotermination_minutes, ' min)')"),
])
rule("dynamic_allocation", 23, "DYNAMIC_ALLOCATION", "k_count", [
    dict(when="points>=3 and mean>0 and round(sd/mean,12)>0.3", severity=W, metric="round(sd/mean,12)", threshold="0.3", advice="'dynamic_allocation'",
         title=f"concat('Executor count unstable (CoV=', {fx('round(sd/mean,12)', 2)}, ')')"),
])
ERR = error_class("failure_reason")
rule("stage_failures", 24, "TASK_FAILURE", "tv_stages", [
    dict(when="status='FAILED' and failure_reason<>''", pos="pos", severity=f"case when {ERR} in ('OOM','SHUFFLE_FETCH','CONTAINER_KILLED') then {C} else {W} end",
         metric="1", threshold="0", entity="concat('stage-', stage_id)", advice=f"concat('stage_failure.', {ERR})",
         title=f"concat('Stage ', stage_id, ' failed (', {ERR}, ')')"),
])
CTES["k_removed"] = f"""
select cluster_id, tick, {removal_class("remove_reason")} cls, count(*) n, min(pos) pos from tv_execs
where not is_active and remove_reason<>'' group by cluster_id, tick, cls"""
rule("executor_failures", 25, "TASK_FAILURE", "k_removed", [
    dict(when="cls<>'UNKNOWN'", pos="pos", severity=f"case when cls in ('OOM','CONTAINER_KILLED') then {C} else {W} end", metric="n", threshold="0",
         advice="concat('removal.', cls)", title="concat(n, ' executor(s) removed (', cls, ')')"),
    dict(source="k_exec", when="excluded_n>0", phase=1, severity=W, metric="excluded_n", threshold="0", advice="'excluded'",
         title="concat(excluded_n, ' executor(s) excluded (blacklisted)')"),
])
KILL = "(cast(killed as double)/tasks*100)"
rule("killed_tasks", 26, "STRAGGLER", "k_stage", [
    dict(when="killed>0 and tasks>0", severity=f"case when {KILL}>10 then {W} else {INFO} end", metric=KILL, threshold="10", advice="'killed_tasks'",
         title=f"concat(killed, ' tasks killed (', {fx(KILL, 1)}, '% of total)')"),
])

DETECTORS = [n[2:] for n in CTES if n.startswith("d_")]
CTES["i_all"] = f"""
select a.*, case severity when 'CRITICAL' then 0 when 'WARNING' then 1 else 2 end sev
from ({" union all ".join(f"select * from d_{n}" for n in DETECTORS)}) a join k_spine s on a.cluster_id=s.cluster_id and a.tick=s.tick"""

ADVICE_CASE = "case advice " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in ADVICE.items()) + " end"
LIST_ORDER = "sev, det, rank_metric desc, phase, pos, slot"


def clamp(x: str) -> str:
    return f"greatest(0, least(100, cast(trunc(round({x}, 9)) as int)))"


def lost(group: str) -> str:
    return f"greatest(0, 100-coalesce(sum(case when category in ({group}) then case severity when 'CRITICAL' then 30 when 'WARNING' then 15 else 0 end end),0))"


CTES["h_lost"] = f"""
select k.cluster_id, k.tick, {lost("'AQE_CONFIG','SERIALIZATION','CONFIG_ANTI_PATTERN','PHOTON_OPPORTUNITY'")} config,
 {lost("'DRIVER_BOTTLENECK'")} driver, {lost("'IO_PATTERN','CPU_IO_BOUND'")} io_efficiency, {lost("'STAGE_RETRY','DYNAMIC_ALLOCATION'")} stability,
 count(i.category) insights, count_if(severity='CRITICAL') critical, count_if(severity='WARNING') warning, count_if(severity='INFO') info
from k_spine k left join i_all i on k.cluster_id=i.cluster_id and k.tick=i.tick group by k.cluster_id, k.tick"""
_gcmax = "(case when worker_n>0 then gc_max else active_gc_max end*100)"
_cov = "(case when worker_n>0 then read_sd/read_mean else aread_sd/aread_mean end)"
_rn = "(case when worker_n>0 then read_n else aread_n end)"
CTES["h_comp"] = f"""
select e.cluster_id, e.tick, active_n, coalesce(active_stages,0) active_stage_count, coalesce(j.running,0) active_job_count,
 l.insights, l.critical, l.warning, l.info,
 case when {_gcmax} is null then 100 else {clamp(f"100-({_gcmax}-2)*(100.0::double/18)")} end gc,
 case when coalesce(active_stages,0)>0 then {clamp("100-spill/10737418240.0::double*100")} else 100 end spill,
 case when {_rn}>=2 and {_cov} is not null then {clamp(f"100-({_cov}-0.3::double)*(100/1.7::double)")} else 100 end skew,
 case when slots>0 then least(100, cast(trunc(round(cast(active_tasks as double)/slots*100*(100/80.0::double),9)) as int)) else 100 end utilization,
 case when shuffle_ratio is null then 100 else {clamp("100-(shuffle_ratio-0.5::double)*(100/4.5::double)")} end shuffle,
 case when done+failed>0 then {clamp("100-(cast(failed as double)/(done+failed)*100)/5*100")} else 100 end task_failures,
 cast(config as int) config, cast(driver as int) driver, cast(io_efficiency as int) io_efficiency, cast(stability as int) stability
from k_exec e left join k_stage s on e.cluster_id=s.cluster_id and e.tick=s.tick left join k_job j on e.cluster_id=j.cluster_id and e.tick=j.tick
join h_lost l on e.cluster_id=l.cluster_id and e.tick=l.tick"""
_w = [("gc", 0.18), ("spill", 0.15), ("skew", 0.15), ("utilization", 0.12), ("shuffle", 0.08), ("task_failures", 0.08), ("config", 0.08), ("driver", 0.06), ("io_efficiency", 0.05), ("stability", 0.05)]
_sum = "+".join(f"{n}*{w}::double" for n, w in _w)
CTES["h_score"] = f"""
select *, case when active_n>0 then {clamp(_sum)} else 0 end score from h_comp"""
CTES["h_label"] = """
select *, case when active_n=0 then 'N/A' when score>=90 then 'Excellent' when score>=70 then 'Good' when score>=50 then 'Fair' when score>=30 then 'Poor' else 'Critical' end as label,
 case when active_n=0 then 'dim' when score>=90 then 'green' when score>=70 then 'blue' when score>=50 then 'yellow' when score>=30 then '#ff8c00' else 'red' end as color from h_score"""
CTES["h_rec"] = f"""
select cluster_id, tick, category, priority, issues, advice, {ADVICE_CASE} description,
 concat(array_to_string(list_transform(string_split(lower(category),'_'), lambda x: concat(upper(x[1]), x[2:])), ' '), ': ', issues, ' issue(s) detected') title,
 row_number() over (partition by cluster_id, tick order by priority, first_rank) place
from (select cluster_id, tick, category, count(*) issues, min(sev)*2+1 priority, min(rank) first_rank, arg_min(advice, rank) advice
 from (select *, row_number() over (partition by cluster_id, tick order by {LIST_ORDER}) rank from i_all) r group by cluster_id, tick, category) g"""
