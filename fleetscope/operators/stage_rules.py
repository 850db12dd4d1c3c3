"""Rules on stages: one row each (``stage``) and one row per key (``key``)."""

from __future__ import annotations

from fleetscope import thresholds as T
from fleetscope.functions.classify import error_class_sql
from fleetscope.operators.rules import Finding, Rule, always, bound, div, grade, num

STAGE_LETS = {
    "measured": "status in ('ACTIVE', 'COMPLETE')",
    "spill": "memory_spill_bytes + disk_spill_bytes",
    "shuffled": "shuffle_read_bytes + shuffle_write_bytes",
    "per_task": div("input_bytes", "num_tasks"),
    "shuffle_load": div("(shuffle_read_bytes + shuffle_write_bytes)", "input_bytes"),
    "progress": div("num_complete_tasks", "num_tasks"),
    "cpu": div("executor_cpu_time_ns", "(executor_run_time_ms * 1000000)"),
    "failure": f"case when status = 'FAILED' and failure_reason <> '' then {error_class_sql('failure_reason')} end",
}
KEY_LETS = {"killed_pct": div("killed_tasks", "stage_tasks") + " * 100D"}
ENTITY = "concat('stage_', stage_id)"


def memory_spill() -> list[Finding]:
    on_disk = f"disk_spill_bytes > {T.SPILL_DISK_BYTES}"
    over_input = f"input_bytes > 0 and try_divide(spill, input_bytes) > {num(T.SPILL_INPUT_RATIO)}"
    return [
        Finding(
            when="measured and spill > 0",
            severity=f"case when {on_disk} or ({over_input}) then 'CRITICAL' else 'WARNING' end",
            category="SPILL",
            title="Memory spill on stage %1$s (%2$s)",
            text="Stage %1$s spilled %2$s, %3$s of it to disk.",
            args=("s:stage_id", "b:spill", "b:disk_spill_bytes"),
            metric="spill",
            threshold=f"case when {on_disk} then {T.SPILL_DISK_BYTES} when {over_input} then input_bytes * {num(T.SPILL_INPUT_RATIO)} else 0 end",
            advice="memory_spill",
            entity=ENTITY,
            ranked=True,
        )
    ]


def shuffle_bottleneck() -> list[Finding]:
    return [
        Finding(
            when=f"measured and input_bytes > 0 and shuffle_load >= {num(T.SHUFFLE_WARN)}",
            severity=grade("shuffle_load", T.SHUFFLE_WARN, T.SHUFFLE_CRIT),
            category="SHUFFLE",
            title="Heavy shuffle on stage %1$s (%2$sx input)",
            text="Stage %1$s shuffled %3$s for %4$s of input.",
            args=("s:stage_id", "1:shuffle_load", "b:shuffled", "b:input_bytes"),
            metric="shuffle_load",
            threshold=bound("shuffle_load", T.SHUFFLE_WARN, T.SHUFFLE_CRIT),
            advice="shuffle_bottleneck",
            entity=ENTITY,
            ranked=True,
        )
    ]


def partition_issues() -> list[Finding]:
    eligible = "status = 'ACTIVE' and num_tasks > 0 and input_bytes > 0"
    common = dict(severity=always("WARNING"), category="PARTITION", entity=ENTITY)
    return [
        Finding(
            when=f"{eligible} and per_task > {T.PARTITION_LARGE}",
            title="Large partitions on stage %1$s (%2$s avg)",
            text="Tasks of stage %1$s read %2$s each on average.",
            args=("s:stage_id", "b:per_task"),
            metric="per_task",
            threshold=str(T.PARTITION_LARGE),
            advice="partition_large",
            **common,
        ),
        Finding(
            when=f"{eligible} and per_task < {T.PARTITION_SMALL}",
            title="Tiny partitions on stage %1$s (%2$s avg, %3$s tasks)",
            text="Tasks of stage %1$s read only %2$s each on average.",
            args=("s:stage_id", "b:per_task", "s:num_tasks"),
            metric="per_task",
            threshold=str(T.PARTITION_SMALL),
            advice="partition_small",
            **common,
        ),
        Finding(
            when=f"{eligible} and cores > 0 and num_tasks < cores",
            title="Too few partitions on stage %1$s (%2$s tasks for %3$s cores)",
            text="Stage %1$s cannot keep %3$s cores busy with %2$s tasks.",
            args=("s:stage_id", "s:num_tasks", "s:cores"),
            metric="try_divide(num_tasks, cores)",
            threshold="1",
            advice="partition_few",
            slot=1,
            **common,
        ),
    ]


def straggler_tasks() -> list[Finding]:
    left = "num_tasks - num_complete_tasks"
    late = f"status = 'ACTIVE' and num_tasks > 0 and progress > {num(T.STRAGGLER_PROGRESS)}"
    tail = f"{left} <= {T.STRAGGLER_REMAINING} and num_active_tasks > 0"
    lone = f"num_active_tasks = 1 and num_complete_tasks > {T.STRAGGLER_MIN_DONE}"
    return [
        Finding(
            when=f"{late} and (({tail}) or ({lone}))",
            severity=f"case when {tail} and {left} = 1 then 'CRITICAL' else 'WARNING' end",
            category="STRAGGLER",
            title="Straggler tasks on stage %1$s (%2$s of %3$s remaining)",
            text="Stage %1$s is %4$s%% done and waits for %2$s task(s).",
            args=("s:stage_id", f"s:{left}", "s:num_tasks", "1:progress * 100D"),
            metric="progress * 100D",
            threshold=num(T.STRAGGLER_PROGRESS * 100.0),
            advice="straggler_tasks",
            entity=ENTITY,
        )
    ]


def io_patterns() -> list[Finding]:
    eligible = "measured and input_bytes > 0 and num_tasks > 0"
    common = dict(severity=always("WARNING"), category="IO_PATTERN", entity=ENTITY)
    return [
        Finding(
            when=f"{eligible} and per_task < {T.SMALL_FILE_BYTES} and num_tasks > {T.SMALL_FILE_TASKS}",
            title="Small file/partition problem on stage %1$s",
            text="%2$s tasks of stage %1$s read %3$s each.",
            args=("s:stage_id", "s:num_tasks", "b:per_task"),
            metric="per_task",
            threshold=str(T.SMALL_FILE_BYTES),
            advice="io_small_files",
            **common,
        ),
        Finding(
            when=f"{eligible} and executor_run_time_ms > 0 and cpu < {num(T.CPU_LOW)}",
            title="I/O bound stage %1$s (CPU efficiency %2$s)",
            text="Stage %1$s used the CPU for %2$s of its run time.",
            args=("s:stage_id", "p:cpu"),
            metric="cpu",
            threshold=num(T.CPU_LOW),
            advice="io_bound",
            slot=1,
            **common,
        ),
    ]


def cpu_io_classification() -> list[Finding]:
    common = dict(severity=always("INFO"), category="CPU_IO_BOUND", metric="active_cpu_mean", args=("p:active_cpu_mean",), pos="0")
    return [
        Finding(
            when=f"active_cpu_mean > {num(T.CPU_HIGH)}",
            title="CPU-bound workload (avg CPU efficiency %1$s)",
            text="Active stages use the CPU for %1$s of their run time.",
            threshold=num(T.CPU_HIGH),
            advice="cpu_bound_workload",
            **common,
        ),
        Finding(
            when=f"active_cpu_mean < {num(T.CPU_LOW)}",
            title="I/O-bound workload (avg CPU efficiency %1$s)",
            text="Active stages use the CPU for only %1$s of their run time.",
            threshold=num(T.CPU_LOW),
            advice="io_bound_workload",
            slot=1,
            **common,
        ),
    ]


def stage_retry_rows() -> list[Finding]:
    return [
        Finding(
            when=f"attempt_id >= {T.RETRY_WARN_ATTEMPT}",
            severity=grade("attempt_id", T.RETRY_WARN_ATTEMPT, T.RETRY_CRIT_ATTEMPT),
            category="STAGE_RETRY",
            title="Stage %1$s retried (attempt %2$s)",
            text="Stage %1$s is on attempt %2$s; earlier attempts failed.",
            args=("s:stage_id", "s:attempt_id"),
            metric="attempt_id",
            threshold="1",
            advice="stage_retries",
            entity=ENTITY,
        )
    ]


def stage_retry_total() -> list[Finding]:
    return [
        Finding(
            when="retried_n > 1 and retried_warn_n > 0",
            severity=always("CRITICAL"),
            category="STAGE_RETRY",
            title="Multiple stages retried (%1$s stages)",
            text="%1$s stages were retried.",
            args=("s:retried_n",),
            metric="retried_n",
            threshold="1",
            advice="stage_retries_many",
            phase=1,
            pos="0",
        )
    ]


def join_strategy() -> list[Finding]:
    return [
        Finding(
            when=f"measured and input_bytes > 0 and input_bytes < {T.JOIN_SMALL_INPUT} and shuffled > input_bytes * {num(T.JOIN_SHUFFLE_RATIO)}",
            severity=always("WARNING"),
            category="JOIN_STRATEGY",
            title="Possible broadcast join candidate (stage %1$s)",
            text="Stage %1$s shuffles %2$s for %3$s of input.",
            args=("s:stage_id", "b:shuffled", "b:input_bytes"),
            metric="shuffle_load",
            threshold=num(T.JOIN_SHUFFLE_RATIO),
            advice="join_strategy",
            entity=ENTITY,
        )
    ]


def stage_failures() -> list[Finding]:
    reason = f"case when length(failure_reason) > {T.REASON_CHARS} then concat(substring(failure_reason, 1, {T.REASON_CHARS}), '...') else failure_reason end"
    return [
        Finding(
            when="failure is not null",
            severity="case when failure in ('OOM', 'SHUFFLE_FETCH', 'CONTAINER_KILLED') then 'CRITICAL' else 'WARNING' end",
            category="TASK_FAILURE",
            title="Stage %1$s failed (%2$s)",
            text="Stage %1$s failed: %3$s",
            args=("s:stage_id", "s:failure", f"s:{reason}"),
            metric="1",
            threshold="0",
            advice="stage_failure.",
            advice_arg=2,
            entity="concat('stage-', stage_id)",
        )
    ]


def killed_tasks() -> list[Finding]:
    return [
        Finding(
            when="killed_tasks > 0 and stage_tasks > 0",
            severity=f"case when killed_pct > {num(T.KILLED_WARN_PCT)} then 'WARNING' else 'INFO' end",
            category="STRAGGLER",
            title="%1$s tasks killed (%2$s%% of total)",
            text="%1$s/%3$s tasks were killed.",
            args=("s:killed_tasks", "1:killed_pct", "s:stage_tasks"),
            metric="killed_pct",
            threshold=num(T.KILLED_WARN_PCT),
            advice="killed_tasks",
            pos="0",
        )
    ]


STAGE_RULES = [
    Rule("memory_spill", 2, "stage", memory_spill),
    Rule("shuffle_bottleneck", 4, "stage", shuffle_bottleneck),
    Rule("partition_issues", 6, "stage", partition_issues),
    Rule("straggler_tasks", 7, "stage", straggler_tasks),
    Rule("io_patterns", 16, "stage", io_patterns),
    Rule("cpu_io_classification", 17, "key", cpu_io_classification),
    Rule("stage_retries", 18, "stage", stage_retry_rows),
    Rule("stage_retries", 18, "key", stage_retry_total),
    Rule("join_strategy", 20, "stage", join_strategy),
    Rule("stage_failures", 24, "stage", stage_failures),
    Rule("killed_tasks", 26, "key", killed_tasks),
]
