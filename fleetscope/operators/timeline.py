"""Ordered operators per series, cut into blocks so that a long series spans many tasks.

``block`` is any monotone integer of the order: ``tick div 4096`` where a series has one row a tick, else the blocks of
``operators.blocks.equal_blocks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope.operators.skew import dense_number

SLIDE_BLOCK = 4096


def previous(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """``lag(value)``: null only on the first row of a series or where the earlier value is null."""
    df = df.withColumn("_blk", block).withColumn("_val", F.struct(value.alias("v")))
    inside = W.partitionBy(*keys, "_blk").orderBy(*order)
    last = df.groupBy(*keys, "_blk").agg(F.max_by("_val", F.struct(*order)).alias("_carry"))
    over_blocks = W.partitionBy(*keys).orderBy("_blk")
    carry = last.withColumn("_carry", F.lag("_carry").over(over_blocks))
    return (
        df.withColumn("_lag", F.lag("_val").over(inside))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_lag", "_carry").getField("v"))
        .drop("_blk", "_val", "_lag", "_carry")
    )


def following(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """``lead(value)``: null only on the last row of a series or where the later value is null."""
    df = df.withColumn("_blk", block).withColumn("_val", F.struct(value.alias("v")))
    inside = W.partitionBy(*keys, "_blk").orderBy(*order)
    first = df.groupBy(*keys, "_blk").agg(F.min_by("_val", F.struct(*order)).alias("_carry"))
    over_blocks = W.partitionBy(*keys).orderBy("_blk")
    carry = first.withColumn("_carry", F.lead("_carry").over(over_blocks))
    return (
        df.withColumn("_lead", F.lead("_val").over(inside))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_lead", "_carry").getField("v"))
        .drop("_blk", "_val", "_lead", "_carry")
    )


def last_known(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """Newest non-null ``value`` up to and including the row."""
    df = df.withColumn("_blk", block).withColumn("_val", value)
    upto = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("_val").isNotNull(), F.struct(*order))
    last = df.groupBy(*keys, "_blk").agg(F.max_by("_val", known).alias("_carry"))
    earlier = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_carry", ignorenulls=True).over(earlier))
    return (
        df.withColumn("_seen", F.last("_val", ignorenulls=True).over(upto))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_seen", "_carry"))
        .drop("_blk", "_val", "_seen", "_carry")
    )


def next_known(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """First non-null ``value`` from the row on."""
    df = df.withColumn("_blk", block).withColumn("_val", value)
    onwards = W.partitionBy(*keys, "_blk").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("_val").isNotNull(), F.struct(*order))
    first = df.groupBy(*keys, "_blk").agg(F.min_by("_val", known).alias("_carry"))
    later = W.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = first.withColumn("_carry", F.last("_carry", ignorenulls=True).over(later))
    return (
        df.withColumn("_seen", F.last("_val", ignorenulls=True).over(onwards))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_seen", "_carry"))
        .drop("_blk", "_val", "_seen", "_carry")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column | None = None, out: str = "idx") -> DataFrame:
    """Place of the row in its series, from 1."""
    return dense_number(df, keys, [F.col(c).asc() for c in order], None if block is None else [block], out)


def sliding(df: DataFrame, keys: list[str], idx: str, size: int, aggs: dict, span: int = SLIDE_BLOCK) -> DataFrame:
    """Aggregates over the last ``size`` rows of a series whose rows are numbered by ``idx``.

    A block carries copies of the ``size - 1`` rows before it, so blocks run independently.
    ``aggs`` maps output name to an aggregate column.
    """
    home = F.floor((F.col(idx) - 1) / span)
    tail = (F.col(idx) - 1) % span >= span - (size - 1)
    spread = df.withColumn("_home", home).withColumn(
        "_blk", F.explode(F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    frame = W.partitionBy(*keys, "_blk").orderBy(idx).rangeBetween(-(size - 1), 0)
    out = spread.select("*", *[agg.over(frame).alias(name) for name, agg in aggs.items()])
    return out.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")
