"""Rules on configuration (``key``), SQL queries (``sql``) and cached datasets (``rdd`` and ``key``)."""

from __future__ import annotations

from fleetscope import thresholds as T
from fleetscope.operators.rules import Finding, Rule, always, bound, div, grade, num


def conf(key: str, default: str) -> str:
    return f"coalesce(try_element_at(spark_conf, '{key}'), '{default}')"


def off(key: str) -> str:
    return f"lower({conf(key, 'true')}) = 'false'"


# ``known`` is null where no configuration was polled for the key, so no rule fires there
CONF_LETS = {
    "known": "spark_conf is not null",
    "aqe_off": off("spark.sql.adaptive.enabled"),
    "coalesce_off": off("spark.sql.adaptive.coalescePartitions.enabled"),
    "skew_join_off": off("spark.sql.adaptive.skewJoin.enabled"),
    "advisory_text": conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", ""),
    "serializer": conf("spark.serializer", "org.apache.spark.serializer.JavaSerializer"),
    "partitions_text": conf("spark.sql.shuffle.partitions", "200"),
    "memory_text": conf("spark.memory.fraction", "0.6"),
    "storage_text": conf("spark.memory.storageFraction", "0.5"),
    "broadcast_text": conf("spark.sql.autoBroadcastJoinThreshold", "10485760"),
}
KEY_LETS = {
    "cache_pct": div("cache_bytes", "worker_memory") + " * 100D",
    "idle": "coalesce(running_jobs, 0) = 0 and coalesce(active_tasks, 0) = 0",
    "vectorised": "upper(coalesce(runtime_engine, '')) like '%PHOTON%'",
}
SQL_LETS = {"slower": div("duration_ms", "query_median_ms"), "failed_jobs": "size(failed_job_ids)"}
RDD_LETS = {
    "cached": div("num_cached_partitions", "num_partitions"),
    "shown_name": "coalesce(nullif(name, ''), concat('RDD ', rdd_id))",
}


def aqe_config() -> list[Finding]:
    common = dict(category="AQE_CONFIG", pos="0")
    switch = dict(metric="0", threshold="1", **common)
    return [
        Finding(
            when="known and aqe_off", severity=always("CRITICAL"), title="AQE is disabled",
            text="Plans are not adapted at run time.", advice="aqe_off", **switch,
        ),
        Finding(
            when="known and not aqe_off and coalesce_off", severity=always("WARNING"),
            title="AQE partition coalescing disabled", text="Small shuffle partitions are not merged.",
            advice="aqe_coalesce_off", slot=1, **switch,
        ),
        Finding(
            when="known and not aqe_off and skew_join_off", severity=always("WARNING"),
            title="AQE skew join optimization disabled", text="Skewed join partitions are not split.",
            advice="aqe_skew_off", slot=2, **switch,
        ),
        Finding(
            when=f"known and not aqe_off and advisory_bytes < {T.ADVISORY_MIN_BYTES}", severity=always("INFO"),
            title="AQE advisory partition size is small (%1$s)", text="Partitions are split down to %1$s.",
            args=("b:advisory_bytes",), metric="advisory_bytes", threshold=str(T.ADVISORY_MIN_BYTES),
            advice="aqe_advisory_small", slot=3, **common,
        ),
    ]


def serialization() -> list[Finding]:
    costly = f"worker_gc_mean >= {num(T.GC_WARN)} or worker_shuffle > {T.SERIALIZER_SHUFFLE_BYTES}"
    return [
        Finding(
            when=f"known and lower(serializer) not like '%kryo%' and worker_gc_n > 0 and ({costly})",
            severity=f"case when worker_gc_mean >= {num(T.GC_CRIT)} then 'CRITICAL' else 'WARNING' end",
            category="SERIALIZATION",
            title="Java serialization in use (Kryo recommended)",
            text="Workers collect for %1$s%% of their time and shuffled %2$s.",
            args=("1:worker_gc_mean * 100D", "b:worker_shuffle"),
            metric="worker_gc_mean * 100D",
            threshold=num(T.GC_WARN * 100.0),
            advice="serialization",
            pos="0",
        )
    ]


def config_anti_patterns() -> list[Finding]:
    common = dict(category="CONFIG_ANTI_PATTERN", pos="0")
    return [
        Finding(
            when=f"known and cores > 0 and partitions > cores * {T.PARTITIONS_PER_CORE} and coalesce_off",
            severity=always("WARNING"), title="Excessive shuffle partitions (%1$s vs %2$s cores)",
            text="%1$s shuffle partitions for %2$s cores, and nothing merges them.", args=("s:partitions", "s:cores"),
            metric="partitions", threshold=f"cores * {T.PARTITIONS_PER_CORE}", advice="conf_partitions", **common,
        ),
        Finding(
            when=f"known and (memory_fraction < {num(T.MEMORY_FRACTION_LOW)} or memory_fraction > {num(T.MEMORY_FRACTION_HIGH)})",
            severity=always("INFO"), title="Unusual memory fraction (%1$s)",
            text="spark.memory.fraction=%1$s is far from its default.", args=("2:memory_fraction",),
            metric="memory_fraction", threshold=num(T.MEMORY_FRACTION_DEFAULT), advice="conf_memory_fraction", slot=1, **common,
        ),
        Finding(
            when=f"known and storage_fraction > {num(T.STORAGE_FRACTION_HIGH)}", severity=always("WARNING"),
            title="High storage fraction (%1$s)", text="spark.memory.storageFraction=%1$s leaves little memory for execution.",
            args=("2:storage_fraction",), metric="storage_fraction", threshold=num(T.STORAGE_FRACTION_HIGH),
            advice="conf_storage_fraction", slot=2, **common,
        ),
        Finding(
            when="known and trim(broadcast_text) = '-1'", severity=always("INFO"), title="Auto broadcast join disabled",
            text="Joins with small tables are shuffled.", metric="-1", threshold="0", advice="conf_broadcast_off", slot=3, **common,
        ),
    ]


def photon_opportunity() -> list[Finding]:
    many = f"timed_queries > {T.VECTOR_MANY_QUERIES} and query_seconds_mean > {num(T.VECTOR_MEAN_SECONDS)}"
    return [
        Finding(
            when=f"known and not vectorised and (({many}) or timed_queries > {T.VECTOR_SOME_QUERIES})",
            severity=f"case when {many} then 'WARNING' else 'INFO' end",
            category="PHOTON_OPPORTUNITY",
            title="Photon runtime may improve SQL performance (%1$s queries)",
            text="%1$s queries ran on the standard runtime, %2$ss each on average.",
            args=("s:timed_queries", "1:query_seconds_mean"),
            metric="timed_queries",
            threshold=str(T.VECTOR_SOME_QUERIES),
            advice="photon_opportunity",
            pos="0",
        )
    ]


def sql_anomalies() -> list[Finding]:
    common = dict(category="SQL_ANOMALY", entity="concat('sql_', execution_id)")
    outlier = f"query_median_ms > 0 and duration_ms > {T.SQL_MIN_MS} and slower >= {num(T.SQL_WARN)}"
    extreme = f"slower >= {num(T.SQL_CRIT)}"
    slow = dict(
        title="SQL query #%1$s is %2$sx slower than median",
        text="Query %1$s took %3$ss; the median is %4$ss.",
        args=("s:execution_id", "0:slower", "0:duration_ms / 1000", "0:query_median_ms / 1000"),
        metric="slower",
        slot=1,
        **common,
    )
    return [
        Finding(
            when=f"status = 'RUNNING' and duration_ms > {T.SQL_LONG_MS}", severity=always("INFO"),
            title="Long-running SQL query #%1$s (%2$ss)", text="Query %1$s has been running for %2$ss.",
            args=("s:execution_id", "0:duration_ms / 1000"), metric="duration_ms", threshold=str(T.SQL_LONG_MS),
            advice="sql_long", **common,
        ),
        Finding(
            when=f"{outlier} and {extreme}", severity=always("CRITICAL"),
            threshold=num(T.SQL_CRIT), advice="sql_outlier_critical", **slow,
        ),
        Finding(
            when=f"{outlier} and not {extreme}", severity=always("WARNING"),
            threshold=num(T.SQL_WARN), advice="sql_outlier_warning", **slow,
        ),
        Finding(
            when="failed_jobs > 0", severity=always("WARNING"), title="SQL query #%1$s has %2$s failed job(s)",
            text="%2$s of %3$s jobs of query %1$s failed.",
            args=("s:execution_id", "s:failed_jobs", "s:success_jobs + failed_jobs + running_jobs"),
            metric="failed_jobs", threshold="0", advice="sql_failed_jobs", slot=2, **common,
        ),
    ]


def partial_cache() -> list[Finding]:
    return [
        Finding(
            when=f"cached < {num(T.CACHE_PARTIAL)}", severity=always("WARNING"), category="CACHING",
            title="Partially cached: %1$s (%2$s)", text="%3$s of %4$s partitions of %1$s are cached.",
            args=("s:shown_name", "p:cached", "s:num_cached_partitions", "s:num_partitions"),
            metric="cached", threshold=num(T.CACHE_PARTIAL), advice="cache_partial", entity="concat('rdd_', rdd_id)",
        )
    ]


def cache_memory() -> list[Finding]:
    return [
        Finding(
            when=f"cache_n > 0 and worker_memory > 0 and cache_pct > {num(T.CACHE_MEM_PCT)}",
            severity=always("WARNING"), category="CACHING", title="High cache memory usage (%1$s%% of executor memory)",
            text="Cached data takes %2$s of executor memory.", args=("0:cache_pct", "b:cache_bytes"),
            metric="cache_pct", threshold=num(T.CACHE_MEM_PCT), advice="cache_memory", phase=1, pos="0",
        )
    ]


def auto_termination() -> list[Finding]:
    common = dict(category="AUTO_TERMINATION", pos="0")
    never = "known and autotermination_minutes = 0"
    return [
        Finding(
            when=f"{never} and idle", severity=always("CRITICAL"), title="Idle cluster with no auto-termination",
            text="Nothing runs, and nothing will stop the cluster.", metric="0", threshold="1", advice="idle_no_timeout", **common,
        ),
        Finding(
            when=f"{never} and not idle", severity=always("WARNING"), title="Auto-termination disabled",
            text="Nothing will stop the cluster once it is idle.", metric="0", threshold="1", advice="no_timeout", **common,
        ),
        Finding(
            when=f"known and autotermination_minutes > {T.IDLE_TIMEOUT_MINUTES}", severity=always("INFO"),
            title="Long auto-termination timeout (%1$s min)", text="The cluster stays up for %1$s idle minutes.",
            args=("s:autotermination_minutes",), metric="autotermination_minutes", threshold=str(T.IDLE_TIMEOUT_MINUTES),
            advice="long_timeout", **common,
        ),
    ]


WORKLOAD_RULES = [
    Rule("aqe_config", 10, "key", aqe_config),
    Rule("serialization", 11, "key", serialization),
    Rule("config_anti_patterns", 14, "key", config_anti_patterns),
    Rule("photon_opportunity", 15, "key", photon_opportunity),
    Rule("sql_anomalies", 19, "sql", sql_anomalies),
    Rule("caching_issues", 21, "rdd", partial_cache),
    Rule("caching_issues", 21, "key", cache_memory),
    Rule("auto_termination", 22, "key", auto_termination),
]
