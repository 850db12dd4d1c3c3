"""Filters and orders of report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns each report may be sorted by
SORT_KEYS = {
    "jobs": ("job_id", "name", "status", "num_completed_tasks", "num_completed_stages", "elapsed_ms", "submission_time"),
    "stages": ("stage_id", "name", "status", "num_complete_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes",
               "shuffle_write_bytes", "spill_bytes", "executor_run_time_ms", "submission_time"),
    "executors": ("executor_id", "host_port", "is_active", "total_cores", "active_tasks", "completed_tasks", "failed_tasks",
                  "memory_used", "gc_ratio", "disk_used", "total_shuffle_read", "total_shuffle_write", "total_duration_ms", "add_time"),
    "sql": ("execution_id", "description", "status", "duration_ms", "running_jobs", "success_jobs", "failed_jobs"),
    "storage": ("rdd_id", "name", "num_cached_partitions", "storage_level", "memory_used", "disk_used", "fraction_cached"),
}


def text_filter(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of ``columns``, ignoring case; empty text keeps all rows."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    hits = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit("None"))).contains(wanted) for c in columns]
    return df.filter(reduce(Column.__or__, hits))


def failures_only(df: DataFrame) -> DataFrame:
    """Failed jobs or stages, and those with failed tasks."""
    return df.filter((F.col("status") == "FAILED") | (F.col("num_failed_tasks") > 0))


def status_filter(df: DataFrame, status: str | None) -> DataFrame:
    """Rows in one state; no state keeps all rows."""
    return df if not status else df.filter(F.col("status") == status.upper())


def _directed(key: str, descending: bool) -> Column:
    return F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()


def pinned_order(report: str, key: str, descending: bool = False, pin: Column | None = None) -> list[Column]:
    """Pinned rows first, both parts by ``key``; null sorts lowest."""
    if key not in SORT_KEYS[report]:
        raise ValueError(f"{report} cannot be sorted by {key}")
    lead = [] if pin is None else [F.when(pin, 0).otherwise(1).asc()]
    return [*lead, _directed(key, descending)]


def executor_order(key: str = "executor_id", descending: bool = False) -> list[Column]:
    """Driver, then active, then dead executors, the last two by ``key``."""
    if key not in SORT_KEYS["executors"]:
        raise ValueError(f"executors cannot be sorted by {key}")
    driver = F.col("executor_id") == "driver"
    group = F.when(driver, 0).when(F.col("is_active"), 1).otherwise(2)
    return [group.asc(), _directed(key, descending)]


def newest(df: DataFrame, keys: list[str], ts: str, limit: int, out: str = "place", tie: str = "pos") -> DataFrame:
    """The ``limit`` newest rows per key.

    Rows are reduced per key and day before any key is brought together, so the final
    step sees at most ``limit`` rows per day.
    """
    from pyspark.sql import Window as W

    order = [F.col(ts).desc(), F.col(tie).desc()]
    daily = W.partitionBy(*keys, "_day").orderBy(*order)
    kept = df.withColumn("_day", F.to_date(ts)).withColumn(out, F.row_number().over(daily)).filter(F.col(out) <= limit)
    return kept.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= limit).drop("_day")
