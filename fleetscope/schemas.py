"""Table contracts.

Every telemetry table carries ``cluster_id`` and ``tick`` (the poll the row belongs to),
``pos`` (its place in the polled list) and the columns below. ``conform`` fills columns a
source does not have with the default of their type, so rules never meet a missing field.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

KEY = ["cluster_id", "tick"]



def columns(ddl: str) -> dict[str, str]:
    """``name type, ...`` -> name to type; no session needed."""
    out, depth, start = {}, 0, 0
    for at, char in enumerate(ddl + ","):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = ddl[start:at].strip().split(" ", 1)
            out[name], start = kind, at + 1
    return out


JOBS = columns(
    "job_id bigint, name string, status string, submission_time timestamp, completion_time timestamp,"
    "num_tasks bigint, num_active_tasks bigint, num_completed_tasks bigint, num_failed_tasks bigint,"
    "num_killed_tasks bigint, killed_tasks_summary map<string,bigint>, num_stages bigint,"
    "num_active_stages bigint, num_completed_stages bigint, num_failed_stages bigint, stage_ids array<bigint>"
)
STAGES = columns(
    "stage_id bigint, attempt_id int, name string, status string, num_tasks bigint, num_active_tasks bigint,"
    "num_complete_tasks bigint, num_failed_tasks bigint, input_bytes bigint, input_records bigint,"
    "output_bytes bigint, output_records bigint, shuffle_read_bytes bigint, shuffle_write_bytes bigint,"
    "executor_run_time_ms bigint, executor_cpu_time_ns bigint, memory_spill_bytes bigint,"
    "disk_spill_bytes bigint, submission_time timestamp, completion_time timestamp, failure_reason string,"
    "num_killed_tasks bigint, killed_tasks_summary map<string,bigint>, jvm_gc_time_ms bigint,"
    "peak_execution_memory bigint"
)
TASK_METRICS = (
    "struct<executor_run_time_ms:bigint,executor_cpu_time_ns:bigint,jvm_gc_time_ms:bigint,"
    "memory_bytes_spilled:bigint,disk_bytes_spilled:bigint,peak_execution_memory:bigint,input_bytes:bigint,"
    "input_records:bigint,output_bytes:bigint,output_records:bigint,shuffle_read_bytes:bigint,"
    "shuffle_local_bytes:bigint,shuffle_write_bytes:bigint,shuffle_fetch_wait_time_ms:bigint>"
)
TASKS = columns(
    "stage_id bigint, attempt_id int, task_id bigint, index bigint, attempt int, status string,"
    "executor_id string, host string, launch_time timestamp, duration_ms bigint, error_message string,"
    f"speculative boolean, task_locality string, metrics {TASK_METRICS}"
)
EXECUTORS = columns(
    "executor_id string, is_active boolean, host_port string, total_cores int, max_tasks int,"
    "active_tasks bigint, completed_tasks bigint, failed_tasks bigint, total_duration_ms bigint,"
    "total_gc_time_ms bigint, max_memory bigint, memory_used bigint, disk_used bigint,"
    "total_input_bytes bigint, total_shuffle_read bigint, total_shuffle_write bigint, rdd_blocks bigint,"
    "peak_jvm_heap bigint, peak_jvm_off_heap bigint, add_time timestamp, remove_time timestamp,"
    "remove_reason string, is_excluded boolean, excluded_in_stages array<bigint>"
)
SQL_QUERIES = columns(
    "execution_id bigint, status string, description string, submission_time timestamp, duration_ms bigint,"
    "running_jobs int, success_jobs int, failed_job_ids array<bigint>"
)
RDDS = columns(
    "rdd_id bigint, name string, num_partitions int, num_cached_partitions int, storage_level string,"
    "memory_used bigint, disk_used bigint"
)
CLUSTERS = columns(
    "cluster_name string, state string, state_message string, start_time timestamp, driver_node_type string,"
    "worker_node_type string, num_workers int, autoscale_min int, autoscale_max int, total_cores double,"
    "total_memory_mb bigint, spark_version string, data_security_mode string, runtime_engine string,"
    "creator string, autotermination_minutes int, spark_conf map<string,string>, tags map<string,string>,"
    "spark_context_id string"
)
CLUSTER_EVENTS = columns(
    "timestamp timestamp, event_type string, message string, details map<string,string>"
)
JOB_RUNS = columns(
    "run_id bigint, job_id bigint, run_name string, state string, result_state string, start_time timestamp,"
    "end_time timestamp, setup_duration_ms bigint, execution_duration_ms bigint, creator string,"
    "run_type string, task_count int"
)
LIBRARIES = columns("name string, library_type string, status string, messages array<string>")

# Columns whose absence means null rather than the default of their type
NULLABLE = {"failure_reason", "error_message", "autoscale_min", "autoscale_max"}
# Defaults that differ from the default of their type
SPECIAL = {"is_active": "true"}


def default_sql(name: str, kind: str) -> str:
    """Value used when a source lacks the column; times stay null."""
    if name in NULLABLE or kind == "timestamp":
        value = "null"
    elif name in SPECIAL:
        value = SPECIAL[name]
    elif kind == "string":
        value = "''"
    elif kind == "boolean":
        value = "false"
    elif kind.startswith("map<"):
        value = "map()"
    elif kind.startswith("array<"):
        value = "array()"
    elif kind.startswith("struct<"):
        parts = columns(kind[len("struct<") : -1].replace(":", " "))
        value = "named_struct(" + ", ".join(f"'{n}', {default_sql(n, k)}" for n, k in parts.items()) + ")"
    else:
        value = "0"
    return f"cast({value} as {kind})"


def conform(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """Keep key columns, cast the contract's columns, add the ones that are missing."""
    names = set(df.columns)
    lead = [c for c in ("cluster_id", "tick", "poll_ts", "pos") if c in names]
    body = [
        f"cast({name} as {kind}) as {name}" if name in names else f"{default_sql(name, kind)} as {name}"
        for name, kind in table.items()
        if name not in lead
    ]
    return df.selectExpr(*lead, *body)


@dataclass(frozen=True)
class Telemetry:
    """The tables an analysis reads. ``rdds`` and ``clusters`` may lack ``tick``: then they hold for every tick.

    ``stages``, ``jobs``, ``sql_queries``, ``rdds`` and ``clusters`` may be absent.
    """

    executors: DataFrame
    stages: DataFrame | None = None
    jobs: DataFrame | None = None
    sql_queries: DataFrame | None = None
    rdds: DataFrame | None = None
    clusters: DataFrame | None = None

    def map_tables(self, change) -> Telemetry:
        """Same tables with ``change(name, df)`` applied to each that is present."""
        found = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{k: change(k, v) for k, v in found.items() if v is not None})
