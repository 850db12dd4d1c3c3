"""Joins, medians and row numbers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.operators.blocks import equal_blocks


def skew_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join of rows with a table of facts, open to a split of skewed keys at run time.

    A side that is already partitioned by the key (an aggregate, say) would be read without an exchange
    of the join's own, and adaptive execution splits skewed partitions only where both sides have one.
    The rebalanced facts have no partitioning, so both sides are exchanged for the join (or the facts broadcast if small).
    """
    return big.join(small.hint("rebalance"), on, how)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact median of positive ``value`` per key: ``keys, out, <out>_n``.

    Distinct values are counted first, then counts per coarse value band (1/1024 of a
    power of two) find the band that holds each middle rank, and only those bands are
    ordered. No task orders more than the values of two bands.
    """
    counted = (
        df.groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_band", F.floor(F.log2("_v") * 1024).cast("int"))
    )
    per_key = W.partitionBy(*keys)
    bands = (
        counted.groupBy(*keys, "_band")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(per_key.orderBy("_band")))
        .withColumn("_total", F.sum("_bc").over(per_key))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
    )
    before = F.col("_upto") - F.col("_bc")
    holds = lambda r: (before < F.col(r)) & (F.col("_upto") >= F.col(r))
    chosen = bands.filter(holds("_lo") | holds("_hi")).select(
        *keys, "_band", before.alias("_before"), "_total", "_lo", "_hi"
    )
    in_band = W.partitionBy(*keys, "_band").orderBy("_v")
    ranked = counted.join(chosen, [*keys, "_band"]).withColumn("_r", F.col("_before") + F.sum("_c").over(in_band))
    reaches = lambda r: F.min(F.when(F.col("_r") >= F.col(r), F.col("_v")))
    return ranked.groupBy(*keys).agg(
        ((reaches("_lo").cast("double") + reaches("_hi").cast("double")) / 2).alias(out),
        F.max("_total").alias(f"{out}_n"),
    )


def dense_number(
    df: DataFrame, keys: list[str], order: list[Column], block: list[Column] | None, out: str
) -> DataFrame:
    """``row_number`` per key without bringing a key together.

    ``block`` must be a coarsening of ``order`` (a prefix, or a monotone bucket of it) that bounds a block's rows; without one,
    blocks of equal rows are cut from the data. Rows are numbered inside their block and shifted by the rows of earlier blocks.
    """
    names = ["_b0"] if block is None else [f"_b{i}" for i in range(len(block))]
    blocked = equal_blocks(df, keys, order, "_b0") if block is None else df.select("*", *[b.alias(n) for b, n in zip(block, names)])
    earlier = W.partitionBy(*keys).orderBy(*[F.col(n).asc() for n in names]).rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    numbered = blocked.withColumn("_rn", F.row_number().over(inside)).join(shifts, [*keys, *names])
    return numbered.withColumn(out, (F.col("_rn") + F.col("_shift")).cast("long")).drop("_rn", "_shift", *names)
