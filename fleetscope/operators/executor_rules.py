"""Rules on executors: one row each (``executor``) and one row per key (``key``)."""

from __future__ import annotations

from fleetscope import thresholds as T
from fleetscope.operators.rules import Finding, Rule, always, bound, div, grade, num, steady

# Columns computed once per row for the rules below
EXECUTOR_LETS = {
    "gc": div("total_gc_time_ms", "total_duration_ms"),
    "used_pct": div("memory_used", "max_memory") + " * 100D",
    "heap_pct": div("peak_jvm_heap", "max_memory") + " * 100D",
}
# Ratios of merged means and deviations differ in the last bits with the order of merging, so they are rounded before a bound
KEY_LETS = {
    "finished": "completed_tasks + failed_tasks",
    "fail_rate": div("failed_tasks", "(completed_tasks + failed_tasks)"),
    "hot_share": div("failed_most.failed_tasks", "failed_tasks") + " * 100D",
    "read_factor": steady(div("read_max", "read_median")),
    "task_cov": steady(div("worker_tasks_sd", "worker_tasks_mean")),
    "slot_pct": div("active_tasks", "slots") + " * 100D",
    "per_core": div("first_worker.max_memory", "first_worker.total_cores"),
    "driver_gc": steady(div("driver.total_gc_time_ms", "driver.total_duration_ms")),
    "driver_pct": div("driver.memory_used", "driver.max_memory") + " * 100D",
    "count_cov": steady(div("count_sd", "count_mean")),
}

REMOVAL_CLASSES = ("OOM", "CONTAINER_KILLED", "TIMEOUT", "SHUFFLE_FETCH")
FATAL_REMOVALS = ("OOM", "CONTAINER_KILLED")


def _gc(when: str, gc: str, who: str, pos: str) -> Finding:
    return Finding(
        when=f"{when} and {gc} >= {num(T.GC_WARN)}",
        severity=grade(gc, T.GC_WARN, T.GC_CRIT),
        category="GC",
        title="High GC pressure on executor %1$s (%2$s%%)",
        text="Executor %1$s spent %2$s%% of its time collecting garbage.",
        args=(f"s:{who}", f"1:{gc} * 100D"),
        metric=f"{gc} * 100D",
        threshold=bound(gc, T.GC_WARN, T.GC_CRIT, 100.0),
        advice="gc_pressure",
        entity=who,
        pos=pos,
        ranked=True,
    )


def gc_pressure() -> list[Finding]:
    return [_gc("is_active and executor_id <> 'driver' and total_duration_ms > 0", "gc", "executor_id", "pos")]


def driver_gc_pressure() -> list[Finding]:
    """The driver counts only where it is the whole cluster."""
    return [_gc("worker_n = 0 and driver.total_duration_ms > 0", "driver_gc", "'driver'", "driver.pos")]


def memory_pressure() -> list[Finding]:
    eligible = "is_active and max_memory > 0"
    common = dict(category="MEMORY", advice="memory_pressure", entity="executor_id", ranked=True)
    return [
        Finding(
            when=f"{eligible} and used_pct >= {num(T.MEM_WARN_PCT)}",
            severity=grade("used_pct", T.MEM_WARN_PCT, T.MEM_CRIT_PCT),
            title="High memory usage on executor %1$s (%2$s%%)",
            text="Executor %1$s holds %3$s of %4$s.",
            args=("s:executor_id", "1:used_pct", "b:memory_used", "b:max_memory"),
            metric="used_pct",
            threshold=bound("used_pct", T.MEM_WARN_PCT, T.MEM_CRIT_PCT),
            **common,
        ),
        Finding(
            when=f"{eligible} and used_pct < {num(T.MEM_WARN_PCT)} and peak_jvm_heap > 0 and heap_pct >= {num(T.HEAP_WARN_PCT)}",
            severity=grade("heap_pct", T.HEAP_WARN_PCT, T.HEAP_CRIT_PCT),
            title="High peak JVM heap on executor %1$s (%2$s%%)",
            text="The heap of executor %1$s peaked at %2$s%% of its memory limit.",
            args=("s:executor_id", "1:heap_pct"),
            metric="heap_pct",
            threshold=bound("heap_pct", T.HEAP_WARN_PCT, T.HEAP_CRIT_PCT),
            slot=1,
            **common,
        ),
    ]


def data_skew() -> list[Finding]:
    return [
        Finding(
            when=f"read_n >= 2 and read_median > 0 and read_factor >= {num(T.SKEW_WARN)}",
            severity=grade("read_factor", T.SKEW_WARN, T.SKEW_CRIT),
            category="SKEW",
            title="Data skew detected: %1$sx shuffle read imbalance",
            text="Executor %2$s read %3$s of shuffle data; the median is %4$s.",
            args=("1:read_factor", "s:read_max_executor", "b:read_max", "b:read_median"),
            metric="read_factor",
            threshold=bound("read_factor", T.SKEW_WARN, T.SKEW_CRIT),
            advice="data_skew",
            entity="read_max_executor",
            pos="0",
        ),
        Finding(
            when=f"read_n >= 2 and worker_tasks_mean > 0 and task_cov >= {num(T.TASK_COV_WARN)}",
            severity=grade("task_cov", T.TASK_COV_WARN, T.TASK_COV_CRIT),
            category="SKEW",
            title="Task distribution skew (CoV=%1$s)",
            text="Completed tasks are spread unevenly over executors: variation %1$s.",
            args=("2:task_cov",),
            metric="task_cov",
            threshold=bound("task_cov", T.TASK_COV_WARN, T.TASK_COV_CRIT),
            advice="task_skew",
            slot=1,
            pos="0",
        ),
    ]


def cluster_utilization() -> list[Finding]:
    low = f"slot_pct < {num(T.UTIL_CRIT_PCT)}"
    return [
        Finding(
            when=f"active_n > 0 and running_jobs > 0 and slots > 0 and slot_pct < {num(T.UTIL_WARN_PCT)}",
            severity=f"case when {low} then 'CRITICAL' else 'WARNING' end",
            category="UTILIZATION",
            title="Low cluster utilization (%1$s%%, %2$s idle executors)",
            text="%3$s of %4$s task slots are busy.",
            args=("0:slot_pct", "s:idle_n", "s:active_tasks", "s:slots"),
            metric="slot_pct",
            threshold=f"case when {low} then {num(T.UTIL_CRIT_PCT)} else {num(T.UTIL_WARN_PCT)} end",
            advice="cluster_utilization",
            pos="0",
        )
    ]


def task_failures() -> list[Finding]:
    enough = f"active_n > 0 and finished >= {T.FAIL_MIN_TASKS}"
    return [
        Finding(
            when=f"{enough} and fail_rate >= {num(T.FAIL_WARN)}",
            severity=grade("fail_rate", T.FAIL_WARN, T.FAIL_CRIT),
            category="TASK_FAILURE",
            title="Task failure rate %1$s%% (%2$s/%3$s tasks)",
            text="%2$s of %3$s finished tasks failed.",
            args=("1:fail_rate * 100D", "s:failed_tasks", "s:finished"),
            metric="fail_rate * 100D",
            threshold=bound("fail_rate", T.FAIL_WARN, T.FAIL_CRIT, 100.0),
            advice="task_failures",
            pos="0",
        ),
        Finding(
            # more than half of all failures: no second executor can qualify
            when=f"{enough} and failed_most.failed_tasks > failed_tasks * {num(T.FAIL_HOTSPOT_SHARE)}",
            severity=always("WARNING"),
            category="TASK_FAILURE",
            title="Executor %1$s has %2$s%% of all task failures",
            text="Executor %1$s accounts for %3$s of %4$s failed tasks.",
            args=("s:failed_most.executor_id", "0:hot_share", "s:failed_most.failed_tasks", "s:failed_tasks"),
            metric="hot_share",
            threshold=num(T.FAIL_HOTSPOT_SHARE * 100.0),
            advice="failure_hotspot",
            entity="failed_most.executor_id",
            phase=1,
            pos="failed_most.pos",
        ),
    ]


def executor_sizing() -> list[Finding]:
    common = dict(severity=always("WARNING"), category="EXECUTOR_SIZING", entity="first_worker.executor_id", pos="0")
    return [
        Finding(
            when=f"first_worker.max_memory > {T.SIZING_HEAP_BYTES}",
            title="Large executor heap (%1$s)",
            text="Executors have %1$s of heap; collections get long above 64 GB.",
            args=("b:first_worker.max_memory",),
            metric="first_worker.max_memory",
            threshold=str(T.SIZING_HEAP_BYTES),
            advice="sizing_heap",
            **common,
        ),
        Finding(
            when=f"first_worker.total_cores > {T.SIZING_CORES}",
            title="High core count per executor (%1$s cores)",
            text="Executors have %1$s cores each, which strains storage clients.",
            args=("s:first_worker.total_cores",),
            metric="first_worker.total_cores",
            threshold=str(T.SIZING_CORES),
            advice="sizing_cores",
            slot=1,
            **common,
        ),
        Finding(
            when=f"first_worker.total_cores > 0 and per_core < {T.SIZING_BYTES_PER_CORE}",
            title="Low memory per core (%1$s/core)",
            text="Each core has only %1$s of memory.",
            args=("b:per_core",),
            metric="per_core",
            threshold=str(T.SIZING_BYTES_PER_CORE),
            advice="sizing_per_core",
            slot=2,
            **common,
        ),
    ]


def driver_bottleneck() -> list[Finding]:
    factor = num(T.DRIVER_GC_FACTOR)
    common = dict(category="DRIVER_BOTTLENECK", entity="'driver'", pos="0")
    return [
        Finding(
            when=f"worker_gc_n > 0 and driver.total_duration_ms > 0 and driver_gc > worker_gc_mean * {factor}"
            f" and driver_gc > {num(T.DRIVER_GC_MIN)}",
            severity=always("WARNING"),
            title="Driver GC pressure (%1$s%% vs %2$s%% avg worker)",
            text="The driver collects garbage at more than twice the rate of the workers.",
            args=("1:driver_gc * 100D", "1:worker_gc_mean * 100D"),
            metric="driver_gc * 100D",
            threshold=f"worker_gc_mean * {factor} * 100D",
            advice="driver_gc",
            **common,
        ),
        Finding(
            when=f"worker_n > 0 and driver.max_memory > 0 and driver_pct > {num(T.DRIVER_MEM_PCT)}",
            severity=always("CRITICAL"),
            title="Driver memory critical (%1$s%%)",
            text="The driver holds %2$s of %3$s.",
            args=("1:driver_pct", "b:driver.memory_used", "b:driver.max_memory"),
            metric="driver_pct",
            threshold=num(T.DRIVER_MEM_PCT),
            advice="driver_memory",
            slot=1,
            **common,
        ),
    ]


def executor_failures() -> list[Finding]:
    removed = [
        Finding(
            when=f"removed_{name} > 0",
            severity=always("CRITICAL" if name in FATAL_REMOVALS else "WARNING"),
            category="TASK_FAILURE",
            title="%1$s executor(s) removed (" + name + ")",
            text="%1$s executor(s) were lost for reason " + name + ".",
            args=(f"s:removed_{name}",),
            metric=f"removed_{name}",
            threshold="0",
            advice=f"removal.{name}",
            pos=f"removed_{name}_pos",
        )
        for name in REMOVAL_CLASSES
    ]
    excluded = Finding(
        when="excluded_n > 0",
        severity=always("WARNING"),
        category="TASK_FAILURE",
        title="%1$s executor(s) excluded (blacklisted)",
        text="%1$s executor(s) no longer receive tasks after repeated failures.",
        args=("s:excluded_n",),
        metric="excluded_n",
        threshold="0",
        advice="excluded",
        phase=1,
        pos="0",
    )
    return [*removed, excluded]


def dynamic_allocation() -> list[Finding]:
    return [
        Finding(
            when=f"count_points >= {T.COUNT_COV_MIN_POINTS} and count_mean > 0 and count_cov > {num(T.COUNT_COV_WARN)}",
            severity=always("WARNING"),
            category="DYNAMIC_ALLOCATION",
            title="Executor count unstable (CoV=%1$s)",
            text="The number of active executors swings around %2$s.",
            args=("2:count_cov", "1:count_mean"),
            metric="count_cov",
            threshold=num(T.COUNT_COV_WARN),
            advice="dynamic_allocation",
            pos="0",
        )
    ]


EXECUTOR_RULES = [
    Rule("gc_pressure", 1, "executor", gc_pressure),
    Rule("gc_pressure", 1, "key", driver_gc_pressure),
    Rule("data_skew", 3, "key", data_skew),
    Rule("cluster_utilization", 5, "key", cluster_utilization),
    Rule("task_failures", 8, "key", task_failures),
    Rule("memory_pressure", 9, "executor", memory_pressure),
    Rule("executor_sizing", 12, "key", executor_sizing),
    Rule("driver_bottleneck", 13, "key", driver_bottleneck),
    Rule("dynamic_allocation", 23, "key", dynamic_allocation),
    Rule("executor_failures", 25, "key", executor_failures),
]
