"""Landed REST documents -> telemetry tables.

Input rows carry the key columns, ``pos`` and one JSON object as text in ``value``. Landed
polls hold a whole list (or an object keyed by index) per document: ``explode_list`` and
``explode_object`` turn them into such rows. Scalars are read as text and coerced, so a
wrong type or a missing field becomes a default and never loses the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions import classify
from fleetscope.functions.parsing import coerce_enum, parse_spark_ts
from fleetscope.operators.skew import dense_number
from fleetscope.operators.tables import newest
from fleetscope.schemas import STAGES
from fleetscope.sources.json_lines import read_json_lines

LEAD = ("cluster_id", "tick", "poll_ts", "pos", "workspace_id", "stage_id", "attempt_id")


def read_documents(spark: SparkSession, path: str, body: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Landed JSON lines ``{cluster_id, tick, slot, <body>}``: readable documents (``body`` kept as text), and the others."""
    return read_json_lines(spark, path, f"cluster_id string, tick int, slot string, {body} string")


def explode_list(documents: DataFrame, body: str = "payload") -> DataFrame:
    """One row per element of a JSON list."""
    items = F.from_json(body, "array<string>")
    return documents.select(*[c for c in documents.columns if c != body], F.posexplode(items).alias("pos", "value"))


def explode_object(documents: DataFrame, body: str = "payload") -> DataFrame:
    """One row per value of a JSON object, or per element if the document is a list."""
    is_list = F.ltrim(body).startswith("[")
    items = F.when(is_list, F.from_json(body, "array<string>")).otherwise(F.map_values(F.from_json(body, "map<string,string>")))
    return documents.select(*[c for c in documents.columns if c != body], F.posexplode(items).alias("pos", "value"))


def _parse(raw: DataFrame, schema: str) -> DataFrame:
    lead = [c for c in raw.columns if c in LEAD]
    return raw.select(*[F.col(c).alias(f"in_{c}") for c in lead], F.from_json("value", schema).alias("r"))


def _respell(raw: DataFrame, other: str, wanted: str) -> DataFrame:
    """Two spellings of a field that differ only in case cannot both be in a schema, so one is renamed in the text."""
    value = F.col("value")
    renamed = F.regexp_replace(value, f'"{other}"\\s*:', f'"{wanted}":')
    return raw.withColumn("value", F.when(value.contains(f'"{other}"'), renamed).otherwise(value))


def _out(parsed: DataFrame, names: list[str], **cols: Column | str) -> DataFrame:
    """Lead columns, then ``cols`` (SQL text or columns) in order."""
    lead = [F.col(f"in_{c}").alias(c) for c in names if c not in cols]
    return parsed.select(*lead, *[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def _lead(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c in LEAD]


def n(field: str, kind: str = "bigint") -> str:
    """Number field: integers as they are, other numbers truncated, anything else 0."""
    whole = f"try_cast({field} as bigint)"
    return f"cast(coalesce({whole}, try_cast(try_cast({field} as double) as bigint), 0) as {kind})"


def s(field: str) -> str:
    return f"coalesce({field}, '')"


def ts(field: str) -> Column:
    return parse_spark_ts(F.col(field))


def millis(field: str) -> str:
    return f"case when {n(field)} > 0 then timestamp_millis({n(field)}) end"


def ingest_jobs(raw: DataFrame) -> DataFrame:
    """Unknown status -> UNKNOWN; the description stands in for an empty name; listed stages for a missing count."""
    parsed = _parse(
        raw,
        "jobId string, name string, description string, status string, submissionTime string, completionTime string,"
        "numTasks string, numActiveTasks string, numCompletedTasks string, numFailedTasks string, numKilledTasks string,"
        "killedTasksSummary map<string,bigint>, numStages string, numActiveStages string, numCompletedStages string,"
        "numFailedStages string, stageIds array<bigint>",
    )
    return _out(
        parsed, _lead(raw),
        job_id=n("r.jobId"), name="coalesce(nullif(r.name, ''), r.description, '')",
        status=coerce_enum(F.col("r.status"), classify.JOB_STATES, classify.UNKNOWN),
        submission_time=ts("r.submissionTime"), completion_time=ts("r.completionTime"),
        num_tasks=n("r.numTasks"), num_active_tasks=n("r.numActiveTasks"), num_completed_tasks=n("r.numCompletedTasks"),
        num_failed_tasks=n("r.numFailedTasks"), num_killed_tasks=n("r.numKilledTasks"),
        killed_tasks_summary="coalesce(r.killedTasksSummary, cast(map() as map<string,bigint>))",
        num_stages=f"case when {n('r.numStages')} <> 0 then {n('r.numStages')} else cast(coalesce(size(r.stageIds), 0) as bigint) end",
        num_active_stages=n("r.numActiveStages"), num_completed_stages=n("r.numCompletedStages"), num_failed_stages=n("r.numFailedStages"),
        stage_ids="coalesce(r.stageIds, cast(array() as array<bigint>))",
    )


def ingest_stages(raw: DataFrame) -> DataFrame:
    """Unknown status -> PENDING; an empty failure reason is null; either spelling of the GC field."""
    fields = {
        "num_tasks": "numTasks", "num_active_tasks": "numActiveTasks", "num_complete_tasks": "numCompleteTasks",
        "num_failed_tasks": "numFailedTasks", "num_killed_tasks": "numKilledTasks", "input_bytes": "inputBytes",
        "input_records": "inputRecords", "output_bytes": "outputBytes", "output_records": "outputRecords",
        "shuffle_read_bytes": "shuffleReadBytes", "shuffle_write_bytes": "shuffleWriteBytes", "executor_run_time_ms": "executorRunTime",
        "executor_cpu_time_ns": "executorCpuTime", "memory_spill_bytes": "memoryBytesSpilled", "disk_spill_bytes": "diskBytesSpilled",
        "peak_execution_memory": "peakExecutionMemory",
    }
    texts = ["stageId", "attemptId", "name", "status", "submissionTime", "completionTime", "failureReason", "jvmGCTime", *fields.values()]
    parsed = _parse(_respell(raw, "jvmGcTime", "jvmGCTime"), ", ".join(f"{f} string" for f in texts) + ", killedTasksSummary map<string,bigint>")
    return _out(
        parsed, _lead(raw),
        stage_id=n("r.stageId"), attempt_id=n("r.attemptId", "int"), name=s("r.name"),
        status=coerce_enum(F.col("r.status"), classify.STAGE_STATES, "PENDING"),
        **{name: n(f"r.{field}") for name, field in fields.items()},
        jvm_gc_time_ms=n("r.jvmGCTime"),
        killed_tasks_summary="coalesce(r.killedTasksSummary, cast(map() as map<string,bigint>))",
        submission_time=ts("r.submissionTime"), completion_time=ts("r.completionTime"), failure_reason="nullif(r.failureReason, '')",
    )


def ingest_executors(raw: DataFrame) -> DataFrame:
    """Live and dead executors; heap peaks from the nested metrics; either spelling of the exclusion fields."""
    fields = {
        "active_tasks": "activeTasks", "completed_tasks": "completedTasks", "failed_tasks": "failedTasks",
        "total_duration_ms": "totalDuration", "total_gc_time_ms": "totalGCTime", "max_memory": "maxMemory", "memory_used": "memoryUsed",
        "disk_used": "diskUsed", "total_input_bytes": "totalInputBytes", "total_shuffle_read": "totalShuffleRead",
        "total_shuffle_write": "totalShuffleWrite", "rdd_blocks": "rddBlocks",
    }
    texts = ["id", "hostPort", "totalCores", "maxTasks", "addTime", "removeTime", "removeReason", *fields.values()]
    parsed = _parse(
        raw,
        ", ".join(f"{f} string" for f in texts)
        + ", isActive boolean, isExcluded boolean, isBlacklisted boolean, excludedInStages array<bigint>, blacklistedInStages array<bigint>,"
        "peakMemoryMetrics struct<JVMHeapMemory:string,JVMOffHeapMemory:string>",
    )
    return _out(
        parsed, _lead(raw),
        executor_id=s("r.id"), is_active="coalesce(r.isActive, true)", host_port=s("r.hostPort"),
        total_cores=n("r.totalCores", "int"), max_tasks=n("r.maxTasks", "int"),
        **{name: n(f"r.{field}") for name, field in fields.items()},
        peak_jvm_heap=n("r.peakMemoryMetrics.JVMHeapMemory"), peak_jvm_off_heap=n("r.peakMemoryMetrics.JVMOffHeapMemory"),
        add_time=ts("r.addTime"), remove_time=ts("r.removeTime"), remove_reason=s("r.removeReason"),
        is_excluded="coalesce(r.isExcluded, false) or coalesce(r.isBlacklisted, false)",
        excluded_in_stages="case when size(r.excludedInStages) > 0 then r.excludedInStages"
        " else coalesce(r.blacklistedInStages, cast(array() as array<bigint>)) end",
    )


def ingest_sql(raw: DataFrame) -> DataFrame:
    parsed = _parse(
        raw,
        "id string, status string, description string, submissionTime string, duration string, runningJobIds array<bigint>,"
        "successJobIds array<bigint>, failedJobIds array<bigint>",
    )
    return _out(
        parsed, _lead(raw),
        execution_id=n("r.id"), status=s("r.status"), description=s("r.description"), submission_time=ts("r.submissionTime"),
        duration_ms=n("r.duration"), running_jobs="coalesce(size(r.runningJobIds), 0)", success_jobs="coalesce(size(r.successJobIds), 0)",
        failed_job_ids="coalesce(r.failedJobIds, cast(array() as array<bigint>))",
    )


def ingest_storage(raw: DataFrame) -> DataFrame:
    texts = ["id", "name", "numPartitions", "numCachedPartitions", "storageLevel", "memoryUsed", "diskUsed"]
    parsed = _parse(raw, ", ".join(f"{f} string" for f in texts))
    return _out(
        parsed, _lead(raw),
        rdd_id=n("r.id"), name=s("r.name"), num_partitions=n("r.numPartitions", "int"), num_cached_partitions=n("r.numCachedPartitions", "int"),
        storage_level=s("r.storageLevel"), memory_used=n("r.memoryUsed"), disk_used=n("r.diskUsed"),
    )


TASK_SCHEMA = (
    "taskId string, index string, attempt string, status string, executorId string, host string, launchTime string, duration string,"
    "errorMessage string, speculative boolean, taskLocality string, taskMetrics struct<executorRunTime:string,executorCpuTime:string,"
    "jvmGcTime:string,memoryBytesSpilled:string,diskBytesSpilled:string,peakExecutionMemory:string,"
    "inputMetrics:struct<bytesRead:string,recordsRead:string>,outputMetrics:struct<bytesWritten:string,recordsWritten:string>,"
    "shuffleReadMetrics:struct<remoteBytesRead:string,localBytesRead:string,fetchWaitTime:string>,"
    "shuffleWriteMetrics:struct<bytesWritten:string>>"
)


def ingest_tasks(raw: DataFrame) -> DataFrame:
    """Task rows with nested metrics. ``shuffle_read_bytes`` counts remote reads; local ones are beside it."""
    m = "r.taskMetrics."
    metrics = {
        "executor_run_time_ms": n(m + "executorRunTime"), "executor_cpu_time_ns": n(m + "executorCpuTime"),
        "jvm_gc_time_ms": n(m + "jvmGcTime"), "memory_bytes_spilled": n(m + "memoryBytesSpilled"),
        "disk_bytes_spilled": n(m + "diskBytesSpilled"), "peak_execution_memory": n(m + "peakExecutionMemory"),
        "input_bytes": n(m + "inputMetrics.bytesRead"), "input_records": n(m + "inputMetrics.recordsRead"),
        "output_bytes": n(m + "outputMetrics.bytesWritten"), "output_records": n(m + "outputMetrics.recordsWritten"),
        "shuffle_read_bytes": n(m + "shuffleReadMetrics.remoteBytesRead"), "shuffle_local_bytes": n(m + "shuffleReadMetrics.localBytesRead"),
        "shuffle_write_bytes": n(m + "shuffleWriteMetrics.bytesWritten"),
        "shuffle_fetch_wait_time_ms": n(m + "shuffleReadMetrics.fetchWaitTime"),
    }
    return _out(
        _parse(_respell(raw, "jvmGCTime", "jvmGcTime"), TASK_SCHEMA), _lead(raw),
        task_id=n("r.taskId"), index=n("r.index"), attempt=n("r.attempt", "int"),
        status=coerce_enum(F.col("r.status"), classify.TASK_STATES, "PENDING"), executor_id=s("r.executorId"), host=s("r.host"),
        launch_time=ts("r.launchTime"), duration_ms=n("r.duration"), error_message="nullif(r.errorMessage, '')",
        speculative="coalesce(r.speculative, false)", task_locality=s("r.taskLocality"),
        metrics="named_struct(" + ", ".join(f"'{k}', {v}" for k, v in metrics.items()) + ")",
    )


def task_page(tasks: DataFrame, status: str = "failed", offset: int = 0, length: int = T.TASK_PAGE) -> DataFrame:
    """Tasks ``offset + 1 .. offset + length`` of a status per stage attempt, in task order."""
    wanted = tasks.filter(F.col("status") == status.upper())
    keys = [c for c in ("cluster_id", "tick", "stage_id", "attempt_id") if c in tasks.columns]
    numbered = dense_number(wanted, keys, [F.col("task_id").asc()], [F.floor(F.col("task_id") / 65536)], "place")
    return numbered.filter((F.col("place") > offset) & (F.col("place") <= offset + length))


SUMMARY_FIELDS = {
    "executor_run_time": "executorRunTime", "jvm_gc_time": "jvmGcTime", "memory_bytes_spilled": "memoryBytesSpilled",
    "disk_bytes_spilled": "diskBytesSpilled", "shuffle_read_bytes": "shuffleReadBytes", "input_bytes": "inputBytes",
}


def ingest_task_summary(raw: DataFrame) -> DataFrame:
    """Quantile vectors per metric; a missing metric has no values."""
    points = ", ".join(f"{q}D" for q in T.QUANTILES)
    parsed = _parse(raw, "quantiles array<double>, " + ", ".join(f"{f} array<double>" for f in SUMMARY_FIELDS.values()))
    empty = "cast(array() as array<double>)"
    return _out(
        parsed, _lead(raw),
        **{
            name: f"named_struct('quantiles', coalesce(r.quantiles, array({points})), 'values', coalesce(r.{field}, {empty}))"
            for name, field in SUMMARY_FIELDS.items()
        },
    )


def stage_lookup(stages: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted ``cluster_id, tick, stage_id, attempt_id``; unknown attempts keep only their key."""
    on = ["cluster_id", "tick", "stage_id", "attempt_id"]
    numbers = [c for c, kind in STAGES.items() if kind in ("bigint", "int") and c not in on and c in stages.columns]
    found = wanted.join(stages, on, "left")
    return found.na.fill(0, numbers).na.fill({"name": "", "status": "PENDING"})


def ingest_clusters(raw: DataFrame) -> DataFrame:
    """Unknown state -> UNKNOWN; epoch milliseconds -> time; missing sizes 0."""
    texts = [
        "cluster_id", "cluster_name", "state", "state_message", "start_time", "driver_node_type_id", "node_type_id", "num_workers",
        "cluster_cores", "cluster_memory_mb", "spark_version", "data_security_mode", "runtime_engine", "creator_user_name",
        "autotermination_minutes", "spark_context_id",
    ]
    parsed = _parse(
        raw,
        ", ".join(f"{f} string" for f in texts)
        + ", autoscale struct<min_workers:int,max_workers:int>, spark_conf map<string,string>, custom_tags map<string,string>",
    )
    return _out(
        parsed, [c for c in _lead(raw) if c != "cluster_id"],
        cluster_id=s("r.cluster_id"), cluster_name=s("r.cluster_name"),
        state=coerce_enum(F.col("r.state"), classify.CLUSTER_STATES, classify.UNKNOWN), state_message=s("r.state_message"),
        start_time=millis("r.start_time"), driver_node_type=s("r.driver_node_type_id"), worker_node_type=s("r.node_type_id"),
        num_workers=n("r.num_workers", "int"), autoscale_min="r.autoscale.min_workers", autoscale_max="r.autoscale.max_workers",
        total_cores="coalesce(try_cast(r.cluster_cores as double), 0D)", total_memory_mb=n("r.cluster_memory_mb"), spark_version=s("r.spark_version"),
        data_security_mode=s("r.data_security_mode"), runtime_engine=s("r.runtime_engine"), creator=s("r.creator_user_name"),
        autotermination_minutes=n("r.autotermination_minutes", "int"),
        spark_conf="coalesce(r.spark_conf, cast(map() as map<string,string>))", tags="coalesce(r.custom_tags, cast(map() as map<string,string>))",
        spark_context_id=s("r.spark_context_id"),
    )


def ingest_cluster_events(raw: DataFrame, polled_at: Column, since: Column | None = None, limit: int = T.EVENTS_FETCHED) -> DataFrame:
    """The newest ``limit`` events per cluster from ``since`` on; an event without a time gets the time of its poll."""
    parsed = _parse(raw, "timestamp string, type string, details map<string,string>")
    rows = _out(
        parsed, _lead(raw),
        timestamp=F.coalesce(F.expr(millis("r.timestamp")), polled_at), event_type=s("r.type"),
        message="coalesce(try_element_at(r.details, 'reason'), '')",
        details="map_filter(coalesce(r.details, cast(map() as map<string,string>)), (k, v) -> v is not null)",
    )
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= since)
    return newest(rows, ["cluster_id"], "timestamp", limit)


ACTIVE_RUN_STATES = ("PENDING", "RUNNING", "TERMINATING", "QUEUED", "BLOCKED", "WAITING_FOR_RETRY")


def ingest_job_runs(raw: DataFrame, active_only: bool = True, limit: int = T.JOB_RUNS_FETCHED) -> DataFrame:
    """The first ``limit`` runs per workspace in source order (``workspace_id``, ``pos``)."""
    texts = ["run_id", "job_id", "run_name", "start_time", "end_time", "setup_duration", "execution_duration", "creator_user_name", "run_type"]
    parsed = _parse(raw, ", ".join(f"{f} string" for f in texts) + ", state struct<life_cycle_state:string,result_state:string>, tasks array<string>")
    rows = _out(
        parsed, _lead(raw),
        run_id=n("r.run_id"), job_id=n("r.job_id"), run_name=s("r.run_name"), state=s("r.state.life_cycle_state"),
        result_state=s("r.state.result_state"), start_time=millis("r.start_time"), end_time=millis("r.end_time"),
        setup_duration_ms=n("r.setup_duration"), execution_duration_ms=n("r.execution_duration"), creator=s("r.creator_user_name"),
        run_type=s("r.run_type"), task_count="coalesce(size(r.tasks), 0)",
    )
    if active_only:
        rows = rows.filter(F.col("state").isin(*ACTIVE_RUN_STATES))
    numbered = dense_number(rows, ["workspace_id"], [F.col("pos").asc()], [F.floor(F.col("pos") / 65536)], "place")
    return numbered.filter(F.col("place") <= limit)


LIBRARY_KINDS = ("pypi", "maven", "jar", "egg", "whl", "cran", "requirements")
PACKAGED = {"pypi": "package", "maven": "coordinates", "cran": "package"}


def ingest_libraries(raw: DataFrame) -> DataFrame:
    """The first kind that is present names the library."""
    kinds = ",".join(f"{k}:struct<{PACKAGED[k]}:string>" if k in PACKAGED else f"{k}:string" for k in LIBRARY_KINDS)
    parsed = _parse(raw, f"library struct<{kinds}>, status string, messages array<string>")
    value = {k: f"r.library.{k}.{PACKAGED[k]}" if k in PACKAGED else f"r.library.{k}" for k in LIBRARY_KINDS}
    kind = "case " + " ".join(f"when r.library.{k} is not null then '{k}'" for k in LIBRARY_KINDS) + " else '' end"
    name = "case " + " ".join(f"when r.library.{k} is not null then {s(value[k])}" for k in LIBRARY_KINDS) + " else '' end"
    return _out(
        parsed, _lead(raw), name=name, library_type=kind, status=s("r.status"), messages="coalesce(r.messages, cast(array() as array<string>))"
    )
