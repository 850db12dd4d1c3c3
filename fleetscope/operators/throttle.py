"""Greedy minimum gap: keep the first time of a series, then each first time at least ``gap`` after the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.lineage import cut
from fleetscope.operators import timeline
from fleetscope.operators.blocks import equal_blocks

DIGIT = 3  # doublings of a round
RADIX = 1 << DIGIT


def successors(times: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``keys, _t, _to``: for each time of a series the first one at least ``gap`` later, null if there is none."""
    points = times.select(*keys, F.col("_t").alias("_at"), F.lit(1).alias("_point"), F.col("_t").alias("_from"))
    marks = times.select(*keys, (F.col("_t") + gap).alias("_at"), F.lit(0).alias("_point"), F.col("_t").alias("_from"))
    order = ["_at", "_point"]
    both = equal_blocks(points.unionByName(marks), keys, [F.col(c).asc() for c in order], "_eq")
    point = F.when(F.col("_point") == 1, F.col("_at"))
    found = timeline.next_known(both, keys, order, F.col("_eq"), point, "_to").filter("_point = 0")
    return found.select(*keys, F.col("_from").alias("_t"), "_to")


def hops(links: DataFrame, keys: list[str]) -> DataFrame:
    """``links`` (``_t, _to``) with ``_hops``, the time and its next ``RADIX - 1`` successors, and ``_to`` as the one after these.

    Each of the joins doubles what a time knows.
    """
    own = links.withColumn("_hops", F.array("_t"))
    for _ in range(DIGIT):
        ahead = own.select(*keys, F.col("_t").alias("_to"), F.col("_hops").alias("_more"), F.col("_to").alias("_then"))
        more = F.coalesce("_more", F.array().cast("array<bigint>"))
        own = own.join(ahead, [*keys, "_to"], "left").select(*keys, "_t", F.concat("_hops", more).alias("_hops"), F.col("_then").alias("_to"))
    return own


def throttle(df: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Kept times per key; ``ts`` and ``gap`` are integers of one unit, null times and keys are left out.

    Which times are kept depends on all earlier ones, but every time has one successor, and the kept ones are what the first
    time's successors lead to. Pointers are lengthened by doubling, to the 8th, 64th, 512th ... successor; then the first
    time is followed from the longest pointers down, each round putting in the times between. A chain of n times takes
    log2(n) joins on single times, and no series is ever one row or one task. Each round of pointers is checkpointed; one
    number, the longest chain there may be, comes to the driver.
    """
    gap = max(gap, 1)
    times = cut(df.select(*keys, F.col(ts).cast("long").alias("_t")).dropna().distinct())
    links = cut(successors(times, keys, gap))
    reach = links.groupBy(*keys).agg(F.least(F.floor((F.max("_t") - F.min("_t")) / gap), F.count("*") - 1).alias("_n"))
    left, rounds = int(reach.agg(F.max("_n")).first()[0] or 0), []
    kept = links.groupBy(*keys).agg(F.min("_t").alias("_t"))
    while left:
        rounds.append(hops(links, keys) if left < RADIX else cut(hops(links, keys)))
        links, left = rounds[-1].select(*keys, "_t", "_to"), left >> DIGIT
    for own in reversed(rounds):
        kept = kept.join(own, [*keys, "_t"]).select(*keys, F.explode("_hops").alias("_t"))
    return kept.withColumnRenamed("_t", ts)
