"""Telemetry views over the provided sample tables.

The text is portable: Spark runs it on DataFrames, and the SQL oracle puts it in front of
its own statements. Every view is a deterministic projection, so telemetry grows with the
tables. ``{name}`` stands for a sample table or an earlier view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.schemas import Telemetry

BASE_TABLES = ("region", "part", "orders", "lineitem", "events")

_MAX_MEMORY = "case cluster_id when 'c4' then 85899345920 when 'c3' then 6442450944 else 17179869184 end"
_EXEC_NO = "case when executor_id='driver' then 0 else cast(replace(executor_id,'driver','0') as int) end"

VIEWS = {
    "tasks": """
select concat('c', cast(l_suppkey % 5 as string)) cluster_id,
 cast(year(l_shipdate)*10+quarter(l_shipdate) as int) tick,
 cast(l_orderkey % 12 as int) stage_id, l_orderkey*10+l_linenumber task_id, cast(l_linenumber % 3 as int) attempt,
 case when l_partkey % 8 = 0 then 'driver' else cast(l_partkey % 8 as string) end executor_id,
 l_shipdate launch_time,
 cast(floor(l_extendedprice) as bigint) duration_ms,
 cast(floor(floor(l_extendedprice)*round(l_tax*100)*(case when l_partkey%8=0 and quarter(l_shipdate)=3 then 12 else 1+(l_partkey%8) end)/300) as bigint) gc_ms,
 cast(floor(floor(l_extendedprice)*1000000*(case l_suppkey%5 when 0 then 13 when 4 then 3 else 2+(l_orderkey%12) end)/16) as bigint) cpu_ns,
 cast(l_quantity as bigint)*case when l_orderkey%12=7 then 16384 when l_orderkey%12=3 then 16777216 else 2097152 end input_bytes,
 cast(l_quantity as bigint)*(case when l_partkey%8=5 and year(l_shipdate)%2=0 then 6 else 1 end)*(l_orderkey%12)*262144 shuffle_read,
 cast(l_quantity as bigint)*(l_orderkey%12)*131072 shuffle_write,
 case when l_discount>=0.085 and l_orderkey%3=0 then cast(l_quantity as bigint)*33554432 else 0 end disk_spill,
 case when l_discount>=0.085 then cast(l_quantity as bigint)*1048576 else 0 end mem_spill,
 case when l_returnflag='R' and l_tax>=0.065 and (l_quantity<=10 or (l_suppkey%5=2 and year(l_shipdate)%2=0)) then 'FAILED'
      when l_linestatus='O' and l_linenumber=7 and l_quantity<=6 then 'RUNNING'
      when l_returnflag='N' and l_quantity<=1 then 'KILLED' else 'SUCCESS' end status,
 case l_linenumber when 1 then 'java.lang.OutOfMemoryError: Java heap space' when 2 then 'Container killed by YARN for exceeding memory limits'
  when 3 then 'org.apache.spark.shuffle.FetchFailedException: Failed to connect' when 4 then 'java.io.NotSerializableException: Foo'
  when 5 then 'java.util.concurrent.TimeoutException: Futures timed out' when 6 then 'Executor heartbeat timed out after 120000 ms' else 'java.lang.IllegalStateException: boom' end error_message
from {lineitem}""",
    "execs": f"""
select cluster_id,tick,executor_id, cast({_EXEC_NO} as bigint) pos,
 (not (executor_id='6' and tick%10=4) and not (cluster_id='c3' and executor_id in ('2','4','5','7') and tick%10 in (2,4))) is_active,
 case when executor_id='6' and tick%10=4 then case cluster_id when 'c0' then 'Container killed by YARN for exceeding memory limits' when 'c1' then 'java.lang.OutOfMemoryError' when 'c2' then 'Executor heartbeat timed out' else 'worker decommissioned' end else '' end remove_reason,
 (executor_id='3' and tick%10=2) is_excluded, concat('10.0.', substr(cluster_id,2,1), '.', cast({_EXEC_NO} as string), ':35000-spark-worker') host_port,
 case when cluster_id='c4' then 12 else 4 end total_cores,
 case when cluster_id='c3' then 0 else 4 end max_tasks,
 cast(sum(case when status='RUNNING' then 1 else 0 end) as bigint) active_tasks,
 cast(sum(case when status='SUCCESS' then 1 else 0 end) as bigint) completed_tasks,
 cast(sum(case when status='FAILED' then 1 else 0 end) as bigint) failed_tasks,
 cast(sum(duration_ms) as bigint) total_duration_ms, cast(sum(gc_ms) as bigint) total_gc_time_ms,
 {_MAX_MEMORY} max_memory,
 cast(floor({_MAX_MEMORY}/100)*(({_EXEC_NO})*13+tick)%101 as bigint) memory_used,
 cast(floor({_MAX_MEMORY}/100)*(({_EXEC_NO})*29+tick)%110 as bigint) peak_jvm_heap,
 cast(sum(input_bytes) as bigint) total_input_bytes, cast(sum(disk_spill) as bigint) disk_used,
 cast(sum(shuffle_read) as bigint) total_shuffle_read, cast(sum(shuffle_write) as bigint) total_shuffle_write,
 min(launch_time) add_time
from {{tasks}} group by cluster_id,tick,executor_id""",
    "stages": """
select cluster_id,tick,stage_id, cast(stage_id as bigint) pos,
 concat('aggregate step ', cast(stage_id as string), ' of the nightly load on ', cluster_id, ' in ', cast(tick as string)) name,
 case when (stage_id+tick)%6=4 then 'FAILED' when (stage_id+tick)%6=5 then 'PENDING' when (stage_id+tick)%6=3 then 'COMPLETE' else 'ACTIVE' end status,
 case when (stage_id+tick)%17=0 then 3 when (stage_id+tick)%11=0 then 1 else 0 end attempt_id,
 cast(count(*) as bigint) num_tasks, cast(sum(case when status='RUNNING' then 1 else 0 end) as bigint) num_active,
 cast(sum(case when status='SUCCESS' then 1 else 0 end) as bigint) num_complete,
 cast(sum(case when status='FAILED' then 1 else 0 end) as bigint) num_failed,
 cast(sum(case when status='KILLED' then 1 else 0 end) as bigint) num_killed,
 cast(sum(input_bytes) as bigint) input_bytes,cast(sum(shuffle_read) as bigint) shuffle_read,cast(sum(shuffle_write) as bigint) shuffle_write,
 cast(sum(duration_ms) as bigint) run_ms,cast(sum(cpu_ns) as bigint) cpu_ns,cast(sum(gc_ms) as bigint) gc_ms,
 cast(sum(mem_spill) as bigint) mem_spill,cast(sum(disk_spill) as bigint) disk_spill,
 case when stage_id%2=0 then 'another attempt succeeded' else 'Stage cancelled' end kill_reason,
 case when (stage_id+tick)%6=4 then case stage_id%6 when 0 then 'java.lang.OutOfMemoryError: Java heap space' when 1 then 'Container killed by YARN for exceeding memory limits' when 2 then 'FetchFailedException: Connection reset' when 3 then 'java.io.NotSerializableException: Foo' when 4 then 'Executor heartbeat timed out' else 'boom' end end failure_reason,
 min(launch_time) submission_time
from {tasks} group by cluster_id,tick,stage_id""",
    "jobs": """
select cluster_id, tick, job_id, job_id pos, status, submission_time,
 case when status<>'RUNNING' then submission_time + interval '90' minute end completion_time, name,
 num_tasks, case when status='RUNNING' then job_id%8 else 0 end num_active,
 case when status='SUCCEEDED' then num_tasks else cast(floor(num_tasks*(job_id%9)/10) as bigint) end num_completed,
 case when status='FAILED' then 1+job_id%7 when job_id%13=0 then 1 else 0 end num_failed,
 num_stages, case when status='RUNNING' then 1 else 0 end num_active_stages,
 case when status='SUCCEEDED' then num_stages else job_id%num_stages end num_completed_stages,
 case when status='FAILED' then 1 else 0 end num_failed_stages, job_id%12 stage_ref
from (select concat('c', cast(o_custkey % 5 as string)) cluster_id, cast(year(o_orderdate)*10+quarter(o_orderdate) as int) tick,
 o_orderkey job_id, case when o_orderstatus='O' and quarter(o_orderdate)<>1 then 'RUNNING' when o_orderstatus='P' and o_orderkey%4=0 then 'FAILED' else 'SUCCEEDED' end status,
 o_orderdate submission_time, 20+o_orderkey%200 num_tasks, 1+o_orderkey%6 num_stages,
 concat('load orders of customer ', cast(o_custkey as string), ' with priority ', o_orderpriority) name
 from {orders}) j""",
    "sqls": """
select concat('c', cast(o_custkey % 5 as string)) cluster_id, cast(year(o_orderdate)*10+quarter(o_orderdate) as int) tick,
 o_orderkey execution_id, o_orderkey pos, case o_orderstatus when 'O' then 'RUNNING' when 'P' then 'FAILED' else 'COMPLETED' end status,
 concat('select sum(total) from orders where customer = ', cast(o_custkey as string), ' and priority = ', o_orderpriority) description,
 cast(floor(o_totalprice) as bigint)*case when o_orderkey%97=0 then 12 when o_orderkey%89=0 then 6 else 1 end duration_ms,
 case when o_orderstatus='O' then 1 else 0 end running_jobs, cast(o_orderkey%5 as int) success_jobs,
 case when o_orderstatus='P' and o_orderkey%10=0 then 2 else 0 end failed_jobs, o_orderdate submission_time from {orders}""",
    "rdds": """
select concat('c', cast(p_partkey % 5 as string)) cluster_id, p_partkey rdd_id, p_partkey pos, p_name as name, p_size num_partitions,
 cast(floor(p_size*(p_partkey%11)/10) as int) num_cached,
 cast(floor(p_retailprice) as bigint)*case when p_partkey%5=1 then 400000 else 100000 end memory_used,
 cast(floor(p_retailprice) as bigint)*(p_partkey%3)*1000 disk_used,
 case when p_partkey%3=0 then 'Memory Deserialized 1x Replicated' else 'Disk Memory Deserialized 1x Replicated' end storage_level from {part}""",
    "conf": """
select concat('c', cast(r_regionkey as string)) cluster_id, r_name cluster_name, case r_regionkey when 2 then 30 when 3 then 240 when 4 then 120 else 0 end autotermination_minutes,
 case r_regionkey when 4 then 'PHOTON' else 'STANDARD' end runtime_engine, cast(2+r_regionkey as int) num_workers,
 case when r_regionkey%2=1 then 2 end autoscale_min, case when r_regionkey%2=1 then 8 end autoscale_max, 30000*(1+r_regionkey) total_memory_mb,
 case r_regionkey when 1 then 'false' end aqe_enabled, case r_regionkey when 2 then 'false' end aqe_coalesce, case r_regionkey when 3 then 'false' end aqe_skew,
 case r_regionkey when 3 then '16MB' end aqe_advisory, case r_regionkey when 4 then 'org.apache.spark.serializer.KryoSerializer' end serializer,
 case r_regionkey when 2 then '2000' end shuffle_partitions, case r_regionkey when 2 then '0.9' when 1 then 'abc' end memory_fraction,
 case r_regionkey when 3 then '0.8' end storage_fraction, case r_regionkey when 3 then '-1' end broadcast_threshold,
 concat('hidden-', r_name) access_key, concat('s3a://landing/', r_name, '/telemetry/year=2024/month=01/day=01/compacted') warehouse_dir from {region}""",
    "polls": """
select concat('c', cast(user_id % 5 as string)) cluster_id,
 case user_id%9 when 0 then 'cluster' when 1 then 'events' when 2 then 'spark_jobs' when 3 then 'stages' when 4 then 'executors' when 5 then 'sql_queries' when 6 then 'storage' when 7 then 'job_runs' else 'libraries' end slot,
 ts poll_ts, event_type<>'error' ok, event_id snapshot_id, value from {events}""",
    "cluster_polls": """
select concat('c', cast(user_id % 5 as string)) cluster_id, ts poll_ts, event_id snapshot_id,
 case when value<20 then 'RESIZING' when value<60 then 'RUNNING' when value<75 then 'TERMINATED' when value<85 then 'PENDING' when value<90 then 'ERROR' else 'RUNNING' end state,
 case when event_type='error' then '' else concat('ctx-', cast(cast(floor(value/25) as int) as string)) end spark_context_id from {events}""",
    "cluster_events": """
select concat('c', cast(user_id % 5 as string)) cluster_id, ts event_ts, event_id pos,
 case event_id%11 when 0 then 'RUNNING' when 1 then 'UPSIZE_COMPLETED' when 2 then 'DRIVER_NOT_RESPONDING' when 3 then 'CREATING' when 4 then 'NODES_LOST' when 5 then 'DOWNSCALED' when 6 then 'TERMINATING' when 7 then 'EDITED' when 8 then 'SPARK_EXCEPTION' when 9 then 'RESIZING' else 'INIT_SCRIPTS_FINISHED' end event_type,
 concat('user ', cast(user_id as string), ' caused ', event_type) message, props from {events}""",
    "runs": """
select concat('c', cast(r_regionkey as string)) cluster_id, concat('run_a_', cast(r_regionkey as string)) run_id, 'before' name, 19951 start_tick, 19974 stop_tick from {region}
union all select concat('c', cast(r_regionkey as string)), concat('run_b_', cast(r_regionkey as string)), 'after', 19981, 20004 from {region}""",
}

CONF_KEYS = {
    "aqe_enabled": "spark.sql.adaptive.enabled",
    "aqe_coalesce": "spark.sql.adaptive.coalescePartitions.enabled",
    "aqe_skew": "spark.sql.adaptive.skewJoin.enabled",
    "aqe_advisory": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "serializer": "spark.serializer",
    "shuffle_partitions": "spark.sql.shuffle.partitions",
    "memory_fraction": "spark.memory.fraction",
    "storage_fraction": "spark.memory.storageFraction",
    "broadcast_threshold": "spark.sql.autoBroadcastJoinThreshold",
    "access_key": "fs.s3a.access.key",
    "warehouse_dir": "spark.sql.warehouse.dir",
}


class SampleViews:
    """The views as DataFrames over ``sf_dir``; nothing is read until a result is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            if name in BASE_TABLES:
                self._views[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                inputs = {n: self.view(n) for n in (*BASE_TABLES, *VIEWS) if "{" + n + "}" in text}
                self._views[name] = self.spark.sql(text, **inputs)
        return self._views[name]

    # -- the same views under the column names of the telemetry tables

    @cached_property
    def tasks(self) -> DataFrame:
        metrics = {
            "executor_run_time_ms": "duration_ms", "executor_cpu_time_ns": "cpu_ns", "jvm_gc_time_ms": "gc_ms",
            "memory_bytes_spilled": "mem_spill", "disk_bytes_spilled": "disk_spill", "input_bytes": "input_bytes",
            "shuffle_read_bytes": "shuffle_read", "shuffle_write_bytes": "shuffle_write",
        }
        zero = [F.lit(0).cast("long").alias(c) for c in ("output_bytes",)]
        return self.view("tasks").withColumn(
            "metrics", F.struct(*[F.col(v).alias(k) for k, v in metrics.items()], *zero)
        )

    @cached_property
    def executors(self) -> DataFrame:
        return self.view("execs")

    @cached_property
    def stages(self) -> DataFrame:
        killed = F.when(F.col("num_killed") > 0, F.create_map("kill_reason", "num_killed"))
        return (
            self.view("stages")
            .withColumn("killed_tasks_summary", F.coalesce(killed, F.create_map().cast("map<string,bigint>")))
            .withColumn("output_bytes", F.floor(F.col("shuffle_write") / 2))
            .withColumnsRenamed(
                {
                    "num_active": "num_active_tasks", "num_complete": "num_complete_tasks", "num_failed": "num_failed_tasks",
                    "num_killed": "num_killed_tasks", "shuffle_read": "shuffle_read_bytes", "shuffle_write": "shuffle_write_bytes",
                    "run_ms": "executor_run_time_ms", "cpu_ns": "executor_cpu_time_ns", "gc_ms": "jvm_gc_time_ms",
                    "mem_spill": "memory_spill_bytes", "disk_spill": "disk_spill_bytes",
                }
            )
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return (
            self.view("jobs")
            .withColumnsRenamed({"num_active": "num_active_tasks", "num_completed": "num_completed_tasks", "num_failed": "num_failed_tasks"})
            .withColumn("stage_ids", F.array("stage_ref"))
        )

    @cached_property
    def sql_queries(self) -> DataFrame:
        ids = F.when(F.col("failed_jobs") > 0, F.array(F.col("execution_id"), F.col("execution_id") + 1))
        return self.view("sqls").withColumn("failed_job_ids", F.coalesce(ids, F.array().cast("array<bigint>")))

    @cached_property
    def rdds(self) -> DataFrame:
        return self.view("rdds").withColumnRenamed("num_cached", "num_cached_partitions")

    @cached_property
    def clusters(self) -> DataFrame:
        pairs = [c for column, key in CONF_KEYS.items() for c in (F.lit(key), F.col(column))]
        conf = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
        return self.view("conf").withColumn("spark_conf", conf)

    @cached_property
    def telemetry(self) -> Telemetry:
        return Telemetry(
            executors=self.executors,
            stages=self.stages,
            jobs=self.jobs,
            sql_queries=self.sql_queries,
            rdds=self.rdds,
            clusters=self.clusters,
        )
