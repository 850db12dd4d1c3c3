"""Slots polled at their own cadence, brought to the report ticks: each report reads the newest good poll of every slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import timeline
from fleetscope.operators.skew import skew_join
from fleetscope.schemas import KEY, Telemetry

TICK_BLOCK = 4096


def source_ticks(spine: DataFrame, polls: DataFrame) -> DataFrame:
    """``cluster_id, tick, source_tick``: the newest good poll at or before each report tick; none before the first.

    ``spine`` holds the report ticks, ``polls`` one row ``cluster_id, tick, ok`` for each poll of the slot. A failed poll
    keeps what was read before.
    """
    marks = spine.select(*KEY, F.lit(True).alias("is_mark"), F.lit(None).cast("int").alias("known"))
    data = polls.filter("ok").select(*KEY, F.lit(False).alias("is_mark"), F.col("tick").alias("known"))
    both = marks.unionByName(data.distinct())
    block = F.floor(F.col("tick") / TICK_BLOCK)
    found = timeline.last_known(both, ["cluster_id"], ["tick", "is_mark"], block, F.col("known"), "source_tick")
    return found.filter("is_mark and source_tick is not null").select(*KEY, "source_tick")


def aligned_rows(rows: DataFrame, spine: DataFrame, polls: DataFrame) -> DataFrame:
    """``rows`` of a slot under the ticks of the reports that read them."""
    sources = source_ticks(spine, polls).withColumnRenamed("tick", "_report")
    read = rows.withColumnRenamed("tick", "source_tick")
    return skew_join(read, sources, ["cluster_id", "source_tick"], "inner").drop("source_tick").withColumnRenamed("_report", "tick").select(*rows.columns)


def align(telemetry: Telemetry, polls: dict[str, DataFrame]) -> Telemetry:
    """``telemetry`` with the tables named in ``polls`` aligned to the ticks of the executor table."""
    spine = telemetry.executors.select(*KEY).distinct()
    return telemetry.map_tables(lambda name, df: aligned_rows(df, spine, polls[name]) if name in polls else df)
