"""Histories over polls: ring buffers, per-executor series, state changes, as-of alignment, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions.numbers import memory_pct, ratio
from fleetscope.operators import timeline
from fleetscope.operators.blocks import equal_blocks
from fleetscope.operators.skew import skew_join
from fleetscope.schemas import KEY

TICK_BLOCK = 4096
SLOT = ["cluster_id", "slot"]


def tick_block() -> Column:
    return F.floor(F.col("tick") / TICK_BLOCK)


def ring_buffer(polls: DataFrame, size: int = T.RING_SIZE) -> DataFrame:
    """Every good poll of a slot with the snapshots then in its buffer: count, oldest, sum of values."""
    good = polls.filter("ok")
    order = timeline.numbered(good, SLOT, ["poll_ts", "snapshot_id"])
    frames = {"buffered": F.count("snapshot_id"), "oldest": F.min("poll_ts"), "total_value": F.sum("value")}
    return timeline.sliding(order, SLOT, "idx", size, frames)


def executor_points(executors: DataFrame) -> DataFrame:
    """Memory and GC share of an executor at each poll, with the place of the poll in its cluster."""
    spine = executors.select(*KEY).distinct()
    placed = timeline.numbered(spine, ["cluster_id"], ["tick"], tick_block())
    memory = memory_pct(F.col("peak_jvm_heap"), F.col("peak_jvm_off_heap"), F.col("memory_used"), F.col("max_memory"))
    gc = ratio(F.col("total_gc_time_ms"), F.col("total_duration_ms")) * 100.0
    points = executors.select(*KEY, "executor_id", memory.alias("memory_pct"), gc.alias("gc_pct"))
    return skew_join(points, placed, KEY, "inner")


def executor_history(executors: DataFrame, column: str, size: int = T.RING_SIZE, shown: int = T.SPARK_POINTS) -> DataFrame:
    """Newest ``shown`` of an executor's points that lie within the last ``size`` polls of its cluster."""
    frames = {"series": F.collect_list(F.struct("tick", F.round(column, 6).alias("value")))}
    series = timeline.sliding(executor_points(executors), ["cluster_id", "executor_id"], "idx", size, frames)
    return series.select(*KEY, "executor_id", F.expr(f"slice(series, greatest(1, size(series) - {shown - 1}), {shown}).value").alias("history"))


def fleet_history(points: DataFrame, column: str, size: int = T.RING_SIZE, shown: int = T.FLEET_POINTS) -> DataFrame:
    """Newest ``shown`` points of a per-poll series within the last ``size`` polls; undefined points are skipped."""
    order = timeline.numbered(points, ["cluster_id"], ["tick"], tick_block())
    frames = {"series": F.collect_list(F.round(column, 6))}
    out = timeline.sliding(order, ["cluster_id"], "idx", size, frames)
    return out.select(*KEY, F.expr(f"slice(series, greatest(1, size(series) - {shown - 1}), {shown})").alias("history"))


def newest_points(points: DataFrame, column: str, cap: int = T.HISTORY_CAP) -> DataFrame:
    """The last ``cap`` points per cluster, numbered from the newest (1).

    The number counts within blocks and is shifted by later blocks, so no series is sorted in one task.
    """
    from fleetscope.operators.skew import dense_number

    ranked = dense_number(points, ["cluster_id"], [F.col("tick").desc()], [-tick_block()], "age")
    return ranked.filter(F.col("age") <= cap).select(*KEY, column, "age")


def _before(polls: DataFrame, value: Column, out: str) -> DataFrame:
    """``value`` of the poll before, per cluster."""
    order = ["poll_ts", "snapshot_id"]
    blocked = equal_blocks(polls, ["cluster_id"], [F.col(c).asc() for c in order], "_eq")
    return timeline.previous(blocked, ["cluster_id"], order, F.col("_eq"), value, out).drop("_eq")


def state_changes(polls: DataFrame) -> DataFrame:
    """Polls at which the cluster state differs from the poll before.

    ``spark_unavailable`` marks the Spark slots bad; ``rediscover`` asks for a new application lookup.
    """
    seen = _before(polls, F.col("state"), "previous_state")
    changed = seen.filter(~F.col("state").eqNullSafe(F.col("previous_state")))
    return changed.withColumns(
        {
            "spark_unavailable": F.col("state").isin("TERMINATED", "ERROR"),
            "rediscover": (F.col("state") == "RUNNING")
            & (F.col("previous_state").isNull() | F.col("previous_state").isin("TERMINATED", "PENDING")),
        }
    )


def context_changes(polls: DataFrame) -> DataFrame:
    """Polls whose non-empty context id differs from the last non-empty one."""
    known = polls.filter(F.col("spark_context_id") != "")
    seen = _before(known, F.col("spark_context_id"), "previous_id")
    return seen.filter(F.col("previous_id").isNotNull() & (F.col("previous_id") != F.col("spark_context_id")))


def slot_asof(spine: DataFrame, polls: DataFrame) -> DataFrame:
    """Newest good snapshot of every slot at each analysis time.

    ``spine``: ``cluster_id, slot, at`` (one row per analysis and slot). A failed poll keeps
    the data before it. A poll at the same instant counts as seen.
    """
    marks = spine.select(*SLOT, F.col("at").alias("ts"), F.lit(1).alias("is_mark"), F.lit(None).cast("bigint").alias("snapshot_id"))
    data = polls.filter("ok").select(*SLOT, F.col("poll_ts").alias("ts"), F.lit(0).alias("is_mark"), "snapshot_id")
    both = marks.unionByName(data).withColumn("tie", F.coalesce("snapshot_id", F.lit(0)))
    order = ["ts", "is_mark", "tie"]
    both = equal_blocks(both, SLOT, [F.col(c).asc() for c in order], "_eq")
    found = timeline.last_known(both, SLOT, order, F.col("_eq"), F.col("snapshot_id"), "asof_snapshot")
    return found.filter(F.col("is_mark") == 1).select(*SLOT, F.col("ts").alias("at"), "asof_snapshot")


def slot_facts(polls: DataFrame) -> DataFrame:
    """Outcome of the last poll of each slot, time of the last good one, number of failed ones; on a stream too (one row per slot)."""
    order = F.struct("poll_ts", "snapshot_id")
    return polls.groupBy(*SLOT).agg(
        F.max_by("ok", order).alias("last_ok"),
        F.max(F.when(F.col("ok"), F.col("poll_ts"))).alias("last_updated"),
        F.count_if(~F.col("ok")).alias("errors"),
    )


def staleness(polls: DataFrame, as_of: Column, intervals: Column) -> DataFrame:
    """State of each slot at ``as_of``: last poll failed, never updated, or older than twice its interval."""
    return staleness_of(slot_facts(polls.filter(F.col("poll_ts") <= as_of)), as_of, intervals)


def staleness_of(facts: DataFrame, as_of: Column, intervals: Column) -> DataFrame:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp"))) / 1e6
    old = age > intervals * T.STALE_FACTOR
    return facts.select(
        *SLOT, "last_updated", "errors", age.alias("age_seconds"),
        (~F.col("last_ok") | F.col("last_updated").isNull() | F.coalesce(old, F.lit(False))).alias("stale"),
    )


def first_worker(executors: DataFrame) -> DataFrame:
    """First active worker in list order."""
    workers = executors.filter("is_active and executor_id <> 'driver'")
    row = F.min_by(F.struct("executor_id", "max_memory", "total_cores"), "pos")
    return workers.groupBy(*KEY).agg(row.alias("w")).select(*KEY, "w.*")


