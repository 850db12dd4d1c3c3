"""Exact quantiles of task metrics per stage, without a per-stage buffer of all values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.operators.rollups import TASK_SUMMARY_METRICS


BELOW_ALL = -(1 << 30)  # band of values that are not positive


def task_quantiles(
    tasks: DataFrame, keys: list[str], metrics: dict[str, str] = TASK_SUMMARY_METRICS, points: tuple[float, ...] = T.QUANTILES
) -> DataFrame:
    """Columns ``<metric>_q<percent>``, linear between the two neighbouring ranks; nulls don't count.

    Metrics become rows, equal values are counted before the shuffle, and ranks come from
    running counts inside value bands, so a stage of any size spreads over many tasks.
    A metric that is null in all tasks of a stage has null quantiles.
    """
    values = F.array(*[F.struct(F.lit(n).alias("m"), F.col(f"metrics.{c}").alias("v")) for n, c in metrics.items()])
    counted = (
        tasks.select(*keys, F.inline(values))
        .groupBy(*keys, "m", "v")
        .agg(F.count("v").alias("c"))
        # never null by its type: a check for nulls on one side of the join below would make the count of values run for each side
        .withColumn("band", F.coalesce(F.when(F.col("v") > 0, F.floor(F.log2("v") * 1024).cast("int")), F.lit(BELOW_ALL)))
    )
    whole = W.partitionBy(*keys, "m")
    bands = (
        counted.groupBy(*keys, "m", "band")
        .agg(F.sum("c").alias("bc"))
        .withColumn("before", F.coalesce(F.sum("bc").over(whole.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n", F.sum("bc").over(whole))
    )
    # a band is opened only if it holds a rank some point needs
    lows = [F.floor((F.col("n") - 1) * p) + 1 for p in points]
    highs = [F.least(low + 1, F.col("n")) for low in lows]
    needed = reduce(lambda a, b: a | b, [(F.col("before") < r) & (F.col("before") + F.col("bc") >= r) for r in [*lows, *highs]])
    inside = W.partitionBy(*keys, "m", "band").orderBy("v")
    ranked = counted.join(bands.filter(needed | (F.col("n") == 0)), [*keys, "m", "band"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))

    def at(rank):
        return F.min(F.when(F.col("upto") >= rank, F.col("v"))).cast("double")

    per_metric = ranked.groupBy(*keys, "m").agg(
        *[
            (at(lo) + (at(hi) - at(lo)) * F.max((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))).alias(f"q{int(p * 100)}")
            for p, lo, hi in zip(points, lows, highs)
        ]
    )
    picked = [F.max(F.when(F.col("m") == n, F.col(f"q{int(p * 100)}"))).alias(f"{n}_q{int(p * 100)}") for n in metrics for p in points]
    return per_metric.groupBy(*keys).agg(*picked)
