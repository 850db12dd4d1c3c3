"""Ingest of REST documents. The documents are made by Spark from the sample views, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.catalog.oracle_base import CTES
from fleetscope.catalog.registry import query
from fleetscope.schemas import KEY
from fleetscope.sources import event_log
from fleetscope.sources import rest_documents as rest

GMT = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'\")"


def documents(df, fields: dict[str, str], lead=("cluster_id", "tick", "pos")):
    """One JSON object per row; null fields are left out of the text."""
    body = ", ".join(f"'{k}', {sql}" for k, sql in fields.items())
    return df.selectExpr(*lead, f"to_json(named_struct({body})) as value")


@query(
    "ingest_jobs",
    """select cluster_id, tick, pos, job_id, case when job_id%10=0 then concat('described ', name) else name end name,
 case when job_id%17=0 then 'UNKNOWN' else status end status, epoch_us(submission_time) submitted_us, num_tasks, num_completed num_completed_tasks,
 num_failed num_failed_tasks, case when job_id%3=0 then 1 else num_stages end num_stages, stage_ref first_stage from tv_jobs""",
)
def ingest_jobs(v):
    raw = documents(v.jobs, {
        "jobId": "job_id", "name": "case when job_id%10=0 then '' else name end", "description": "concat('described ', name)",
        "status": "case when job_id%17=0 then 'odd' else lower(status) end", "submissionTime": GMT.format("submission_time"),
        "numTasks": "cast(num_tasks as string)", "numCompletedTasks": "num_completed_tasks", "numFailedTasks": "num_failed_tasks",
        "numStages": "case when job_id%3=0 then null else num_stages end", "stageIds": "stage_ids",
    })
    return rest.ingest_jobs(raw).select(
        *KEY, "pos", "job_id", "name", "status", F.unix_micros("submission_time").alias("submitted_us"), "num_tasks", "num_completed_tasks",
        "num_failed_tasks", "num_stages", F.col("stage_ids")[0].alias("first_stage"),
    )


@query(
    "ingest_stages",
    """select cluster_id, tick, cast(stage_id as bigint) stage_id, attempt_id, case when stage_id=5 then 'PENDING' else status end status, num_tasks, input_bytes,
 shuffle_read shuffle_read_bytes, mem_spill memory_spill_bytes, gc_ms jvm_gc_time_ms, failure_reason, num_killed killed from tv_stages""",
)
def ingest_stages(v):
    raw = documents(v.stages, {
        "stageId": "stage_id", "attemptId": "attempt_id", "status": "case when stage_id=5 then 'LOST' else status end", "numTasks": "num_tasks",
        "inputBytes": "input_bytes", "shuffleReadBytes": "shuffle_read_bytes", "memoryBytesSpilled": "memory_spill_bytes",
        "jvmGCTime": "case when stage_id%2=0 then jvm_gc_time_ms end", "jvmGcTime": "case when stage_id%2=1 then jvm_gc_time_ms end",
        "failureReason": "coalesce(failure_reason, '')", "killedTasksSummary": "killed_tasks_summary",
    })
    killed = F.coalesce(F.try_element_at(F.map_values("killed_tasks_summary"), F.lit(1)), F.lit(0))
    return rest.ingest_stages(raw).select(
        *KEY, "stage_id", "attempt_id", "status", "num_tasks", "input_bytes", "shuffle_read_bytes", "memory_spill_bytes", "jvm_gc_time_ms",
        "failure_reason", killed.alias("killed"),
    )


@query(
    "ingest_executors",
    """select cluster_id, tick, executor_id, is_active, total_cores, max_tasks, completed_tasks, total_gc_time_ms, max_memory, peak_jvm_heap, remove_reason, is_excluded,
 case when is_excluded then 1 else 0 end excluded_stages from tv_execs""",
)
def ingest_executors(v):
    raw = documents(v.executors, {
        "id": "executor_id", "isActive": "case when is_active then null else false end", "totalCores": "total_cores", "maxTasks": "max_tasks",
        "completedTasks": "completed_tasks", "totalGCTime": "total_gc_time_ms", "maxMemory": "max_memory",
        "peakMemoryMetrics": "named_struct('JVMHeapMemory', peak_jvm_heap)", "removeReason": "nullif(remove_reason, '')",
        "isBlacklisted": "is_excluded", "excludedInStages": "cast(array() as array<bigint>)",
        "blacklistedInStages": "case when is_excluded then array(7L) end",
    })
    return rest.ingest_executors(raw).select(
        *KEY, "executor_id", "is_active", "total_cores", "max_tasks", "completed_tasks", "total_gc_time_ms", "max_memory", "peak_jvm_heap",
        "remove_reason", "is_excluded", F.size("excluded_in_stages").alias("excluded_stages"),
    )


@query("ingest_sql", "select cluster_id, tick, execution_id, status, description, duration_ms, running_jobs, success_jobs, failed_jobs from tv_sqls")
def ingest_sql(v):
    raw = documents(v.sql_queries, {
        "id": "execution_id", "status": "status", "description": "description", "duration": "duration_ms",
        "runningJobIds": "case when running_jobs=1 then array(execution_id) end",
        "successJobIds": "case when success_jobs>0 then sequence(1, success_jobs) end", "failedJobIds": "failed_job_ids",
    })
    return rest.ingest_sql(raw).select(
        *KEY, "execution_id", "status", "description", "duration_ms", "running_jobs", "success_jobs", F.size("failed_job_ids").alias("failed_jobs")
    )


@query("ingest_storage", "select cluster_id, rdd_id, name, num_partitions, num_cached num_cached_partitions, storage_level, memory_used, disk_used from tv_rdds")
def ingest_storage(v):
    raw = documents(v.rdds, {
        "id": "rdd_id", "name": "name", "numPartitions": "num_partitions", "numCachedPartitions": "num_cached_partitions",
        "storageLevel": "storage_level", "memoryUsed": "memory_used", "diskUsed": "disk_used",
    }, lead=("cluster_id", "pos"))
    return rest.ingest_storage(raw).drop("pos")


CTES["n_page"] = "select *, row_number() over (partition by cluster_id, tick, stage_id order by task_id) place from (select distinct cluster_id, tick, stage_id, task_id, attempt, duration_ms, shuffle_read, error_message from tv_tasks where status='FAILED') f"


@query(
    "ingest_tasks",
    "select cluster_id, tick, cast(stage_id as bigint) stage_id, task_id, status, executor_id, duration_ms, gc_ms, cpu_ns, mem_spill, disk_spill, shuffle_read, shuffle_read*2 local_read, error_message from tv_tasks",
)
def ingest_tasks(v):
    raw = documents(v.view("tasks").withColumn("stage_id", F.col("stage_id").cast("long")), {
        "taskId": "task_id", "attempt": "attempt", "status": "lower(status)", "executorId": "executor_id", "duration": "duration_ms",
        "errorMessage": "error_message",
        "taskMetrics": "named_struct('executorRunTime', duration_ms, 'executorCpuTime', cpu_ns, 'jvmGcTime', gc_ms, 'memoryBytesSpilled', mem_spill,"
        " 'diskBytesSpilled', disk_spill, 'shuffleReadMetrics', named_struct('remoteBytesRead', shuffle_read, 'localBytesRead', shuffle_read*2))",
    }, lead=("cluster_id", "tick", "stage_id"))
    m = {"gc_ms": "jvm_gc_time_ms", "cpu_ns": "executor_cpu_time_ns", "mem_spill": "memory_bytes_spilled", "disk_spill": "disk_bytes_spilled",
         "shuffle_read": "shuffle_read_bytes", "local_read": "shuffle_local_bytes"}
    return rest.ingest_tasks(raw).select(
        *KEY, "stage_id", "task_id", "status", "executor_id", "duration_ms", *[F.col(f"metrics.{c}").alias(n) for n, c in m.items()], "error_message"
    )


@query("task_page", "select cluster_id, tick, stage_id, count(*) tasks, min(place) first_place, max(place) last_place from n_page where place>2 and place<=7 group by cluster_id, tick, stage_id")
def task_page(v):
    failed = v.view("tasks").filter("status = 'FAILED'").select(*KEY, "stage_id", "task_id", "attempt", "duration_ms", "shuffle_read", "error_message", "status").distinct()
    page = rest.task_page(failed, offset=2, length=5)
    return page.groupBy(*KEY, "stage_id").agg(F.count(F.lit(1)).alias("tasks"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@query(
    "ingest_task_summary",
    "select cluster_id, tick, stage_id, num_tasks::double run_first, cast(run_ms as double) run_last, 5 points, 0 gc_values from tv_stages",
)
def ingest_task_summary(v):
    raw = documents(
        v.stages, {"executorRunTime": "array(num_tasks, executor_run_time_ms)"}, lead=("cluster_id", "tick", "stage_id")
    )
    run = F.col("executor_run_time.values")
    return rest.ingest_task_summary(raw).select(
        *KEY, "stage_id", run[0].alias("run_first"), run[1].alias("run_last"), F.size("executor_run_time.quantiles").alias("points"),
        F.size("jvm_gc_time.values").alias("gc_values"),
    )


@query(
    "stage_lookup",
    """select w.cluster_id, w.tick, w.stage_id, w.attempt_id, coalesce(status,'PENDING') status, coalesce(num_tasks,0) num_tasks, coalesce(name,'') name
 from (select cluster_id, tick, stage_id, 0 attempt_id from tv_stages) w left join tv_stages s on w.cluster_id=s.cluster_id and w.tick=s.tick and w.stage_id=s.stage_id and w.attempt_id=s.attempt_id""",
)
def stage_lookup(v):
    wanted = v.stages.select(*KEY, "stage_id", F.lit(0).alias("attempt_id"))
    found = rest.stage_lookup(v.stages, wanted)
    return found.select(*KEY, "stage_id", "attempt_id", "status", "num_tasks", "name")


@query(
    "ingest_clusters",
    """select cluster_id, cluster_name, case when cluster_id='c2' then 'UNKNOWN' else 'RUNNING' end state, num_workers, autoscale_min, autoscale_max, total_memory_mb,
 autotermination_minutes, runtime_engine, case when cluster_id='c0' then null else 1700000000000000 end started_us, (select count(*) from r_conf r where r.cluster_id=c.cluster_id) conf_size from tv_conf c""",
)
def ingest_clusters(v):
    raw = documents(v.clusters, {
        "cluster_id": "cluster_id", "cluster_name": "cluster_name", "state": "case when cluster_id='c2' then 'odd' else 'Running' end",
        "num_workers": "num_workers", "autoscale": "case when autoscale_min is not null then named_struct('min_workers', autoscale_min, 'max_workers', autoscale_max) end",
        "cluster_memory_mb": "total_memory_mb", "autotermination_minutes": "nullif(autotermination_minutes, 0)", "runtime_engine": "runtime_engine",
        "start_time": "case when cluster_id='c0' then 0 else 1700000000000 end", "spark_conf": "spark_conf",
    }, lead=("cluster_id",))
    return rest.ingest_clusters(raw).select(
        "cluster_id", "cluster_name", "state", "num_workers", "autoscale_min", "autoscale_max", "total_memory_mb", "autotermination_minutes",
        "runtime_engine", F.unix_micros("start_time").alias("started_us"), F.size("spark_conf").cast("long").alias("conf_size"),
    )


CTES["n_events"] = "select *, row_number() over (partition by cluster_id order by event_ms desc, pos desc) place from (select *, epoch_us(event_ts)//1000 event_ms from tv_cluster_events) e where event_ms>=1706000000000"


@query("ingest_cluster_events", "select cluster_id, event_type, message, event_ms, case when props is null then 1 else 2 end detail_count, place from n_events where place<=50")
def ingest_cluster_events(v):
    events = v.view("cluster_events")
    raw = documents(events, {
        "timestamp": "unix_millis(cast(event_ts as timestamp))", "type": "event_type",
        "details": "named_struct('reason', message, 'props', props, 'missing', cast(null as string))",
    }, lead=("cluster_id", "pos"))
    rows = rest.ingest_cluster_events(raw, F.lit("2024-02-01").cast("timestamp"), F.timestamp_millis(F.lit(1706000000000)))
    return rows.select(
        "cluster_id", "event_type", "message", F.unix_millis("timestamp").alias("event_ms"), F.size("details").alias("detail_count"), "place"
    )


CTES["n_runs"] = "select *, row_number() over (partition by cluster_id order by job_id) place from tv_jobs where status='RUNNING'"


@query("ingest_job_runs", "select cluster_id workspace_id, job_id run_id, name run_name, 'RUNNING' state, cast(num_stages as int) task_count, epoch_us(submission_time) started_us, place from n_runs where place<=20")
def ingest_job_runs(v):
    raw = documents(v.jobs.withColumn("workspace_id", F.col("cluster_id")), {
        "run_id": "job_id", "run_name": "name", "start_time": "unix_millis(cast(submission_time as timestamp))",
        "state": "named_struct('life_cycle_state', case when status='RUNNING' then 'RUNNING' else 'TERMINATED' end)",
        "tasks": "transform(sequence(1, num_stages), x -> named_struct('key', x))",
    }, lead=("workspace_id", "pos"))
    return rest.ingest_job_runs(raw).select(
        "workspace_id", "run_id", "run_name", "state", "task_count", F.unix_micros("start_time").alias("started_us"), "place"
    )


@query(
    "ingest_libraries",
    """select p_partkey, case p_partkey%5 when 0 then 'pypi' when 1 then 'maven' when 2 then 'jar' when 3 then 'whl' else '' end library_type,
 case p_partkey%5 when 0 then p_name when 1 then concat('org:', p_name) when 2 then concat('/jars/', p_name) when 3 then p_name else '' end name, 'INSTALLED' status from part""",
)
def ingest_libraries(v):
    part = v.view("part").withColumn("pos", F.col("p_partkey"))
    raw = documents(part, {
        "library": "named_struct('pypi', case when p_partkey%5=0 then named_struct('package', p_name) end,"
        " 'maven', case when p_partkey%5=1 then named_struct('coordinates', concat('org:', p_name)) end,"
        " 'jar', case when p_partkey%5=2 then concat('/jars/', p_name) end, 'whl', case when p_partkey%5=3 then p_name end)",
        "status": "'INSTALLED'",
    }, lead=("pos",))
    return rest.ingest_libraries(raw).select(F.col("pos").alias("p_partkey"), "library_type", "name", "status")




# ---------------------------------------------------------------- event log

YEAR_S = 31_536_000
_TICK = f"cast(floor({{0}} / {1000 * YEAR_S}) as int)"
CTES["g_tasks"] = "select *, epoch_us(launch_time)//1000 + duration_ms done_ms from tv_tasks where status<>'RUNNING'"
CTES["g_spans"] = f"""
select cluster_id, 'job' kind, cast(job_id as varchar) id, epoch_us(submission_time)//1000 a, epoch_us(completion_time)//1000 b, status final, num_tasks n1, cast(1 as bigint) n2 from tv_jobs
union all select cluster_id, 'sql', cast(execution_id as varchar), epoch_us(submission_time)//1000, case when status<>'RUNNING' then epoch_us(submission_time)//1000 + duration_ms end, status, duration_ms, 0 from tv_sqls
union all select cluster_id, 'stage', cast(stage_id as varchar), min(epoch_us(launch_time)//1000), case when stage_id%2=0 then max(done_ms) end, case when stage_id=4 then 'FAILED' else 'COMPLETE' end, 0, 0 from g_tasks group by cluster_id, stage_id
union all select cluster_id, 'executor', executor_id, min(epoch_us(launch_time)//1000), case when executor_id='6' then max(done_ms) end, 'REMOVED', 0, 0 from g_tasks group by cluster_id, executor_id"""
CTES["g_ticks"] = f"""select distinct cluster_id, {_TICK.format('ms')} tick from
 (select cluster_id, unnest([a, b]) ms from g_spans union all select cluster_id, done_ms from g_tasks) e where ms is not null"""
CTES["g_shown"] = f"""select s.*, t.tick, b is not null and t.tick>={_TICK.format('b')} ended from g_spans s join g_ticks t
 on s.cluster_id=t.cluster_id and t.tick>={_TICK.format('a')} and (b is null or t.tick<={_TICK.format('b')})"""
CTES["g_counts"] = f"""select cluster_id, {_TICK.format('done_ms')} tick, 'stage' kind, cast(stage_id as varchar) id, count_if(status='SUCCESS') c1, sum(shuffle_read) c2 from g_tasks group by all
union all select cluster_id, {_TICK.format('done_ms')}, 'executor', executor_id, count_if(status='SUCCESS'), sum(gc_ms) from g_tasks group by all"""


@query(
    "ingest_event_log",
    f"""select g.cluster_id, g.tick, g.kind, g.id,
 case when not g.ended then case g.kind when 'stage' then 'ACTIVE' when 'executor' then 'ADDED' else 'RUNNING' end else g.final end status,
 cast(case g.kind when 'job' then g.n1 when 'sql' then case when g.ended then g.n1 else 0 end else coalesce(c1, 0) end as bigint) first_count,
 cast(case g.kind when 'job' then g.n2 when 'sql' then case when j.b is not null and {_TICK.format('j.b')}<=g.tick and j.final='FAILED' then 1 else 0 end else coalesce(c2, 0) end as bigint) second_count
 from g_shown g left join g_counts c on g.cluster_id=c.cluster_id and g.tick=c.tick and g.kind=c.kind and g.id=c.id
 left join (select * from g_spans where kind='job') j on g.kind='sql' and g.cluster_id=j.cluster_id and g.id=j.id""",
)
def ingest_event_log(v):
    """Jobs, queries, stages and executors of the log that Spark writes of the sample's work, as text lines, at ticks of a year."""
    log = event_log.EventLog(event_log.parse_events(_event_lines(v)), YEAR_S)
    jobs = log.jobs.selectExpr(*KEY, "'job' kind", "cast(job_id as string) id", "status", "num_tasks first_count", "cast(size(stage_ids) as bigint) second_count")
    sql = log.sql_queries.selectExpr(*KEY, "'sql' kind", "cast(execution_id as string) id", "status", "duration_ms first_count", "cast(size(failed_job_ids) as bigint) second_count")
    stages = log.stages.selectExpr(*KEY, "'stage' kind", "cast(stage_id as string) id", "status", "num_complete_tasks first_count", "shuffle_read_bytes second_count")
    executors = log.executors.selectExpr(
        *KEY, "'executor' kind", "executor_id id", "if(is_active, 'ADDED', 'REMOVED') status", "completed_tasks first_count", "total_gc_time_ms second_count"
    )
    return jobs.unionByName(sql).unionByName(stages).unionByName(executors)


def _event_lines(v):
    """JSON lines of an event log, with start and end events in separate lines."""
    ms = lambda c: f"cast(floor(unix_micros(cast({c} as timestamp)) / 1000) as bigint)"
    lines = lambda df, *fields: df.selectExpr("cluster_id", "to_json(named_struct(" + ", ".join(fields) + ")) value")
    event = lambda name: f"'Event', '{name}'"
    tasks = v.view("tasks").filter("status <> 'RUNNING'").selectExpr("*", f"{ms('launch_time')} + duration_ms done_ms", f"{ms('launch_time')} from_ms")
    out = [
        lines(
            tasks, event("SparkListenerTaskEnd"), "'Stage ID', stage_id", "'Stage Attempt ID', 0",
            "'Task End Reason', named_struct('Reason', if(status = 'SUCCESS', 'Success', 'ExceptionFailure'), 'Description', error_message)",
            "'Task Info', named_struct('Task ID', task_id, 'Attempt', attempt, 'Launch Time', from_ms, 'Finish Time', done_ms, 'Executor ID', executor_id,"
            " 'Failed', status = 'FAILED', 'Killed', status = 'KILLED')",
            "'Task Metrics', named_struct('Executor Run Time', duration_ms, 'JVM GC Time', gc_ms, 'Shuffle Read Metrics', named_struct('Remote Bytes Read', shuffle_read))",
        )
    ]
    jobs = v.jobs
    stage_infos = "array(named_struct('Stage ID', stage_ref, 'Number of Tasks', num_tasks))"
    out.append(lines(jobs, event("SparkListenerJobStart"), "'Job ID', job_id", f"'Submission Time', {ms('submission_time')}", "'Stage IDs', stage_ids",
                     f"'Stage Infos', {stage_infos}", "'Properties', map('spark.job.description', name, 'spark.sql.execution.id', cast(job_id as string))"))
    out.append(lines(jobs.filter("completion_time is not null"), event("SparkListenerJobEnd"), "'Job ID', job_id", f"'Completion Time', {ms('completion_time')}",
                     "'Job Result', named_struct('Result', if(status = 'SUCCEEDED', 'JobSucceeded', 'JobFailed'))"))
    sql = v.view("sqls")
    start = f"'time', {ms('submission_time')}"
    out.append(lines(sql, event(f"{event_log.SQL}Start"), "'executionId', execution_id", "'description', description", start, "'sparkPlanInfo', named_struct('nodeName', 'Range')"))
    out.append(lines(sql.filter("status <> 'RUNNING'"), event(f"{event_log.SQL}End"), "'executionId', execution_id", f"'time', {ms('submission_time')} + duration_ms",
                     "'errorMessage', if(status = 'FAILED', 'boom', '')"))
    stages = tasks.groupBy("cluster_id", "stage_id").agg(F.min("from_ms").alias("a"), F.max("done_ms").alias("b"), F.count("*").alias("n"))
    info = "'Stage ID', stage_id, 'Stage Attempt ID', 0, 'Stage Name', 'step', 'Number of Tasks', n, 'Submission Time', a"
    out.append(lines(stages, event("SparkListenerStageSubmitted"), f"'Stage Info', named_struct({info})"))
    out.append(lines(stages.filter("stage_id % 2 = 0"), event("SparkListenerStageCompleted"),
                     f"'Stage Info', named_struct({info}, 'Completion Time', b, 'Failure Reason', if(stage_id = 4, 'boom', null))"))
    executors = tasks.groupBy("cluster_id", "executor_id").agg(F.min("from_ms").alias("a"), F.max("done_ms").alias("b"))
    out.append(lines(executors, event("SparkListenerExecutorAdded"), "'Timestamp', a", "'Executor ID', executor_id", "'Executor Info', named_struct('Host', 'h', 'Total Cores', 4)"))
    out.append(lines(executors.filter("executor_id = '6'"), event("SparkListenerExecutorRemoved"), "'Timestamp', b", "'Executor ID', executor_id", "'Removed Reason', 'worker lost'"))
    all_lines = out[0]
    for more in out[1:]:
        all_lines = all_lines.unionByName(more)
    return all_lines
