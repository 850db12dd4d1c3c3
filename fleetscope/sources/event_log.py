"""Spark event logs (JSON lines) -> the tables of an analysis.

One schema reads all kinds of events in one pass. Start and end events of a job, stage, query or executor meet in one aggregate by its
id (map-side merged, in any order, delivered twice or not), which gives its span in ticks; the ticks of the log within the
span come from the interval join, so an entity is shown at every tick from its start to its end, running until then.
Counters are those of the tasks that finished in the tick. What never ended is running at the last tick of its log.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.lineage import keep, keep_large
from fleetscope.operators.intervals import inside
from fleetscope.operators.rollups import executor_rollup, stage_rollup
from fleetscope.operators.skew import skew_join
from fleetscope.schemas import CLUSTERS, EXECUTORS, JOBS, KEY, SQL_QUERIES, STAGES, Telemetry, conform

_STAGE_INFO = (
    "struct<`Stage ID`:bigint,`Stage Attempt ID`:int,`Stage Name`:string,`Number of Tasks`:bigint,`Submission Time`:bigint,"
    "`Completion Time`:bigint,`Failure Reason`:string>"
)
SCHEMA = (
    "Event string, Timestamp bigint, `App Name` string, `Spark Properties` map<string,string>,"
    "`Job ID` bigint, `Submission Time` bigint, `Completion Time` bigint, `Job Result` struct<Result:string>, `Stage IDs` array<bigint>,"
    f" `Stage Infos` array<{_STAGE_INFO}>, Properties map<string,string>, `Stage Info` {_STAGE_INFO},"
    "`Executor ID` string, `Executor Info` struct<Host:string,`Total Cores`:int>, `Removed Reason` string,"
    "executionId bigint, description string, time bigint, errorMessage string, sparkPlanInfo string,"
    " `Stage ID` bigint, `Stage Attempt ID` int, `Task End Reason` struct<Reason:string,`Full Stack Trace`:string,Description:string>,"
    "`Task Info` struct<`Task ID`:bigint,Index:bigint,Attempt:int,`Launch Time`:bigint,`Executor ID`:string,Host:string,Locality:string,"
    "Speculative:boolean,`Finish Time`:bigint,Failed:boolean,Killed:boolean>,"
    "`Task Metrics` struct<`Executor Run Time`:bigint,`Executor CPU Time`:bigint,`JVM GC Time`:bigint,`Memory Bytes Spilled`:bigint,"
    "`Disk Bytes Spilled`:bigint,`Peak Execution Memory`:bigint,`Input Metrics`:struct<`Bytes Read`:bigint,`Records Read`:bigint>,"
    "`Output Metrics`:struct<`Bytes Written`:bigint,`Records Written`:bigint>,"
    "`Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint,`Fetch Wait Time`:bigint>,"
    "`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint>>"
)


SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"
EXECUTION_ID = "spark.sql.execution.id"

TASK_END = "SparkListenerTaskEnd"
JOB = ("SparkListenerJobStart", "SparkListenerJobEnd")
STAGE = ("SparkListenerStageSubmitted", "SparkListenerStageCompleted")
EXECUTOR = ("SparkListenerExecutorAdded", "SparkListenerExecutorRemoved")
QUERY = (f"{SQL}Start", f"{SQL}End")
APPLICATION = ("SparkListenerApplicationStart", "SparkListenerEnvironmentUpdate")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def parse_events(lines: DataFrame) -> DataFrame:
    """Events from the text column ``value``; other columns stay. A line that isn't an object has no ``Event`` and is in no table."""
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.from_json("value", SCHEMA).alias("_e")).select(*kept, "_e.*")


def finished_tasks(events: DataFrame, cluster_id: str | None = None, tick_seconds: int | None = None, beside: list[Column] | None = None) -> DataFrame:
    """``SparkListenerTaskEnd`` events as task rows; unlisted metrics are 0.

    With ``tick_seconds`` a task gets the tick in which it finished (seconds since 1970 over the tick's length), so that
    the rows can be rolled up by key to the stage and executor tables of an analysis. With columns ``beside`` those of a task, the
    events of other kinds stay as well.
    """
    ends = events.filter(F.col("Event") == TASK_END) if beside is None else events
    metric = {
        "executor_run_time_ms": "`Executor Run Time`", "executor_cpu_time_ns": "`Executor CPU Time`", "jvm_gc_time_ms": "`JVM GC Time`",
        "memory_bytes_spilled": "`Memory Bytes Spilled`", "disk_bytes_spilled": "`Disk Bytes Spilled`",
        "peak_execution_memory": "`Peak Execution Memory`", "input_bytes": "`Input Metrics`.`Bytes Read`",
        "input_records": "`Input Metrics`.`Records Read`", "output_bytes": "`Output Metrics`.`Bytes Written`",
        "output_records": "`Output Metrics`.`Records Written`", "shuffle_read_bytes": "`Shuffle Read Metrics`.`Remote Bytes Read`",
        "shuffle_local_bytes": "`Shuffle Read Metrics`.`Local Bytes Read`",
        "shuffle_write_bytes": "`Shuffle Write Metrics`.`Shuffle Bytes Written`",
        "shuffle_fetch_wait_time_ms": "`Shuffle Read Metrics`.`Fetch Wait Time`",
    }
    info, reason = "`Task Info`", "`Task End Reason`"
    metrics = ", ".join(f"'{k}', coalesce(`Task Metrics`.{v}, 0)" for k, v in metric.items())
    key = [f"'{cluster_id}' as cluster_id"] if cluster_id is not None else [c for c in ("cluster_id", "tick") if c in events.columns]
    if tick_seconds is not None:
        key = [k for k in key if k != "tick"] + [f"cast(floor({info}.`Finish Time` / {1000 * tick_seconds}) as int) as tick"]
    columns = [
        *key, "`Stage ID` as stage_id", "`Stage Attempt ID` as attempt_id", f"{info}.`Task ID` as task_id", f"{info}.Index as index",
        f"{info}.Attempt as attempt",
        f"case when {info}.Killed then 'KILLED' when {info}.Failed or {reason}.Reason <> 'Success' then 'FAILED' else 'SUCCESS' end as status",
        f"coalesce({info}.`Executor ID`, '') as executor_id", f"coalesce({info}.Host, '') as host",
        f"timestamp_millis({info}.`Launch Time`) as launch_time", f"{info}.`Finish Time` - {info}.`Launch Time` as duration_ms",
        f"nullif(coalesce({reason}.`Full Stack Trace`, {reason}.Description), '') as error_message",
        f"coalesce({info}.Speculative, false) as speculative", f"coalesce({info}.Locality, '') as task_locality",
        f"named_struct({metrics}) as metrics",
    ]
    return ends.select(*[F.expr(c) for c in columns], *(beside or []))


def _by_kind(*columns: tuple[tuple[str, ...], Column]) -> Column:
    """A column that kinds of events share: that of the event's kind."""
    return F.coalesce(*[F.when(F.col("Event").isin(*kinds), column) for kinds, column in columns])


@dataclass
class EventLog:
    """The tables in the events of any number of logs. ``events`` has ``cluster_id`` and the columns of ``SCHEMA``.

    What the tables read of the events, the ticks and the spans of jobs are kept from their first use, so that lines are parsed once.
    """

    events: DataFrame
    tick_seconds: int

    def _tick(self, millis: Column) -> Column:
        return F.floor(millis / (1000 * self.tick_seconds)).cast("int")

    def _of(self, *kinds: str) -> DataFrame:
        return self.facts.filter(F.col("Event").isin(*kinds))

    @cached_property
    def facts(self) -> DataFrame:
        """What the tables read of each event, in flat columns that its kinds share, kept.

        Flat columns are kept packed. Nested ones, as the events have, are not: they take several times the room.
        """
        info, executor = (lambda c: F.col("`Stage Info`").getField(c)), F.col("`Executor Info`")
        at = F.coalesce("Timestamp", "Completion Time", "Submission Time", F.col("`Task Info`").getField("Finish Time"), info("Completion Time"), info("Submission Time"), "time")
        tasks = F.aggregate(F.coalesce("Stage Infos", F.array()), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(i["Number of Tasks"], F.lit(0)))
        job = F.col("Event") == JOB[0]
        own = {
            "Event": F.col("Event"), "at": self._tick(at),
            "id": _by_kind((JOB, F.col("Job ID")), (QUERY, F.col("executionId")), (STAGE, info("Stage ID")), ((TASK_END,), F.col("Stage ID"))),
            "attempt": _by_kind((STAGE, info("Stage Attempt ID")), ((TASK_END,), F.col("Stage Attempt ID"))),
            "executor": _by_kind((EXECUTOR, F.col("Executor ID"))),
            "start": _by_kind((JOB, F.col("Submission Time")), (QUERY[:1], F.col("time")), (STAGE, info("Submission Time")), (EXECUTOR[:1], F.col("Timestamp"))),
            "end": _by_kind((JOB, F.col("Completion Time")), (QUERY[1:], F.col("time")), (STAGE, info("Completion Time")), (EXECUTOR[1:], F.col("Timestamp"))),
            "name": _by_kind((JOB, F.try_element_at("Properties", F.lit("spark.job.description"))), (QUERY, F.col("description")), (STAGE, info("Stage Name")),
                             (EXECUTOR, executor.getField("Host")), (APPLICATION, F.col("App Name"))),
            "outcome": _by_kind((JOB, F.col("Job Result").getField("Result")), (QUERY, F.col("errorMessage")), (STAGE, info("Failure Reason")), (EXECUTOR, F.col("Removed Reason"))),
            "size": _by_kind((JOB, tasks), (STAGE, info("Number of Tasks")), (EXECUTOR, executor.getField("Total Cores").cast("long"))),
            "stage_ids": F.when(job, F.col("Stage IDs")),
            "execution_id": F.when(job, F.expr(f"try_cast(try_element_at(Properties, '{EXECUTION_ID}') as bigint)")),
            "plan": _by_kind((QUERY, F.col("sparkPlanInfo"))), "spark_conf": _by_kind((APPLICATION, F.col("Spark Properties"))),
        }
        rows = finished_tasks(self.events, tick_seconds=self.tick_seconds, beside=[c.alias(f"_{n}") for n, c in own.items()])
        shared = {"executor": F.when(F.col("_Event") == TASK_END, F.col("executor_id")).otherwise(F.col("_executor"))}
        return keep_large(
            rows.select("cluster_id", *[shared.get(n, F.col(f"_{n}")).alias(n) for n in own], "tick", "status", "launch_time", "duration_ms", "metrics.*")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Ticks in which anything happened."""
        return keep(self.facts.select("cluster_id", F.col("at").alias("tick")).dropna().distinct())

    @property
    def tasks(self) -> DataFrame:
        return finished_tasks(self.events, tick_seconds=self.tick_seconds)

    def _counted(self) -> DataFrame:
        """What rollups read of the tasks."""
        metrics = F.struct(*self.facts.columns[self.facts.columns.index("duration_ms") + 1 :])
        ids = [F.col("id").alias("stage_id"), F.col("attempt").alias("attempt_id"), F.col("executor").alias("executor_id")]
        return self._of(TASK_END).select(*KEY, *ids, "status", "launch_time", "duration_ms", metrics.alias("metrics"))

    def _shown(self, spans: DataFrame) -> DataFrame:
        """A row for each tick from ``_start`` to ``_end`` (milliseconds; a null end is open), and whether it has ended by then."""
        placed = spans.withColumns({"_from": self._tick(F.col("_start")), "_upto": self._tick(F.col("_end"))})
        rows = inside(self.ticks, placed, ["cluster_id"], "tick", "_from", "_upto", bare=True)
        return rows.withColumn("_ended", F.col("_upto").isNotNull() & (F.col("tick") >= F.col("_upto"))).drop("_from", "_upto")

    @cached_property
    def job_spans(self) -> DataFrame:
        first = F.when(F.col("Event") == JOB[0], F.struct("stage_ids", F.col("size").alias("num_tasks"), F.col("name").alias("description"), "execution_id"))
        return keep_large(
            self._of(*JOB).groupBy("cluster_id", F.col("id").alias("job_id")).agg(
                F.min("start").alias("_start"), F.max("end").alias("_end"), F.any_value(first, ignoreNulls=True).alias("f"), F.max("outcome").alias("_result")
            )
        )

    @property
    def jobs(self) -> DataFrame:
        rows = self._shown(self.job_spans)
        status = F.when(~F.col("_ended"), "RUNNING").when(F.col("_result") == "JobSucceeded", "SUCCEEDED").otherwise("FAILED")
        name = F.coalesce("f.description", F.concat(F.lit("job "), "job_id"))
        shown = rows.select(
            *KEY, F.col("job_id").alias("pos"), "job_id", status.alias("status"), name.alias("name"), F.timestamp_millis("_start").alias("submission_time"),
            F.when(F.col("_ended"), F.timestamp_millis("_end")).alias("completion_time"), F.col("f.num_tasks").alias("num_tasks"),
            F.coalesce("f.stage_ids", F.array().cast("array<bigint>")).alias("stage_ids"),
        )
        return conform(shown.withColumn("num_stages", F.size("stage_ids")), JOBS)

    @property
    def stages(self) -> DataFrame:
        spans = self._of(*STAGE).groupBy("cluster_id", F.col("id").alias("stage_id"), F.col("attempt").alias("attempt_id")).agg(
            F.min("start").alias("_start"), F.max("end").alias("_end"), F.max("name").alias("name"),
            F.max("size").alias("num_tasks"), F.max("outcome").alias("_reason"),
        )
        rows = self._shown(spans)
        id_ = [*KEY, "stage_id", "attempt_id"]
        counted = stage_rollup(self._counted(), id_).drop("num_tasks", "submission_time")
        status = F.when(~F.col("_ended"), "ACTIVE").when(F.col("_reason").isNull(), "COMPLETE").otherwise("FAILED")
        rows = rows.withColumns({"status": status, "failure_reason": F.when(F.col("_ended"), F.col("_reason")), "pos": F.col("stage_id"),
                                 "submission_time": F.timestamp_millis("_start"), "completion_time": F.when(F.col("_ended"), F.timestamp_millis("_end"))})
        joined = skew_join(rows, counted, id_, "left")
        return conform(joined.na.fill(0, [c for c in counted.columns if c not in id_]), STAGES)

    @property
    def executors(self) -> DataFrame:
        spans = self._of(*EXECUTOR).groupBy("cluster_id", F.col("executor").alias("executor_id")).agg(
            F.min("start").alias("_start"), F.max("end").alias("_end"), F.max("name").alias("host_port"),
            F.max("size").cast("int").alias("total_cores"), F.max("outcome").alias("_reason"),
        )
        rows = self._shown(spans)
        id_ = [*KEY, "executor_id"]
        counted = executor_rollup(self._counted(), id_)
        rows = rows.withColumns({"is_active": ~F.col("_ended"), "max_tasks": F.col("total_cores"), "remove_reason": F.when(F.col("_ended"), F.col("_reason")).otherwise(""),
                                 "pos": F.coalesce(F.expr("try_cast(executor_id as bigint)"), F.lit(0)), "add_time": F.timestamp_millis("_start"),
                                 "remove_time": F.when(F.col("_ended"), F.timestamp_millis("_end"))})
        joined = skew_join(rows, counted, id_, "left")
        return conform(joined.na.fill(0, [c for c in counted.columns if c not in id_]), EXECUTORS)

    @property
    def sql_spans(self) -> DataFrame:
        return self._of(*QUERY).groupBy("cluster_id", F.col("id").alias("execution_id")).agg(
            F.min("start").alias("_start"), F.max("end").alias("_end"),
            F.max("name").alias("description"), F.max("outcome").alias("_error"), F.max("plan").alias("plan"),
        )

    @property
    def sql_queries(self) -> DataFrame:
        job = F.struct("job_id", self._tick(F.col("_end")).alias("upto"), (F.col("_result") == "JobSucceeded").alias("good"))
        # a query's own jobs meet it once, before it is shown at its ticks
        jobs = self.job_spans.select("cluster_id", "f.execution_id", job.alias("job")).filter("execution_id is not null")
        own = jobs.groupBy("cluster_id", "execution_id").agg(F.sort_array(F.collect_list("job")).alias("_jobs"))
        spans = self.sql_spans.join(own, ["cluster_id", "execution_id"], "left")
        rows = self._shown(spans.withColumn("_jobs", F.coalesce("_jobs", F.array().cast(own.schema["_jobs"].dataType))))
        ended = lambda j: j["upto"].isNotNull() & (j["upto"] <= F.col("tick"))
        of = lambda wanted: F.filter("_jobs", wanted)
        rows = rows.withColumns({
            "running_jobs": F.size(of(lambda j: ~ended(j))), "success_jobs": F.size(of(lambda j: ended(j) & j["good"])),
            "failed_job_ids": F.transform(of(lambda j: ended(j) & ~j["good"]), lambda j: j["job_id"]),
        })
        error = F.coalesce(F.col("_error"), F.lit("")) != ""
        status = F.when(~F.col("_ended"), "RUNNING").when(error, "FAILED").otherwise("COMPLETED")
        rows = rows.withColumns({"status": status, "pos": F.col("execution_id"), "submission_time": F.timestamp_millis("_start"),
                                 "duration_ms": F.when(F.col("_ended"), F.col("_end") - F.col("_start"))})
        return conform(rows.na.fill(0, ["duration_ms"]), SQL_QUERIES)

    @property
    def clusters(self) -> DataFrame:
        """Name and configuration, which hold for every tick."""
        rows = self._of(*APPLICATION).groupBy("cluster_id").agg(
            F.max("name").alias("cluster_name"), F.any_value("spark_conf", ignoreNulls=True).alias("spark_conf")
        )
        filled = rows.withColumn("spark_conf", F.coalesce("spark_conf", F.create_map().cast("map<string,string>")))
        return conform(filled, CLUSTERS)

    @property
    def telemetry(self) -> Telemetry:
        return Telemetry(executors=self.executors, stages=self.stages, jobs=self.jobs, sql_queries=self.sql_queries, clusters=self.clusters)
