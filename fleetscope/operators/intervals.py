"""Join of points with the intervals that hold them, without comparing every point with every interval.

The line is cut into nodes of ``BASE ** level`` units. An interval is the disjoint union of at most ``2 * (BASE - 1)`` nodes a level (its
ragged ends on small nodes, its middle on large ones); a point lies in one node of each level. So interval and point share
exactly one node if the point is inside and none if it isn't: an equi-join on nodes whose every row is a result, however
many intervals a key has and however they overlap. Ends beyond the key's own points are drawn in first, so that an open or a
very long interval has no more nodes than the points call for. Only distinct points, without their payload, are spread over
the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.skew import skew_join

BITS = 6  # BASE = 64
LEVELS = 7

NODE = "struct<level:int,node:bigint>"


def point_nodes(point: Column) -> Column:
    """The node of each level that holds ``point``."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(point, BITS * k).alias("node")) for k in range(LEVELS)])


def _run(level: int, first: Column, end: Column) -> Column:
    """Nodes ``first`` to ``end - 1`` of a level."""
    numbers = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))


def interval_nodes(df: DataFrame, start: str, stop: str, out: str) -> DataFrame:
    """Adds the nodes whose disjoint union is ``[start, stop]``.

    Each level has the nodes that lie wholly inside, without what whole nodes of the next level cover.
    """
    begin, end = F.col(start).cast("long"), F.col(stop).cast("long") + 1
    first = [F.shiftright(begin + ((1 << (BITS * k)) - 1), BITS * k) for k in range(LEVELS)]
    last = [F.shiftright(end, BITS * k) for k in range(LEVELS)]
    pieces = []
    for k in range(LEVELS - 1):
        above = first[k + 1] < last[k + 1]
        pieces.append(_run(k, first[k], F.when(above, F.shiftleft(first[k + 1], BITS)).otherwise(last[k])))
        pieces.append(_run(k, F.when(above, F.shiftleft(last[k + 1], BITS)).otherwise(last[k]), last[k]))
    return df.withColumn(out, F.concat(*pieces, _run(LEVELS - 1, first[-1], last[-1])))


def inside(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, stop: str, bare: bool = False) -> DataFrame:
    """Rows of ``points`` with the columns of each interval of their key that holds them (both ends belong to it).

    A null stop is open; a null point, start or key matches nothing. An interval that ends before it starts holds nothing.
    ``bare`` points are distinct and have no columns but ``keys`` and ``point``: the intervals are not joined with their payload then.
    """
    places = points.filter(F.col(point).isNotNull()).select(*keys, F.col(point).cast("long").alias("_at")).distinct()
    reach = places.groupBy(*keys).agg(F.min("_at").alias("_least"), F.max("_at").alias("_most"))
    drawn = skew_join(intervals, reach, keys, "inner").withColumns(
        {"_from": F.greatest(F.col(start).cast("long"), "_least"), "_to": F.least(F.coalesce(F.col(stop).cast("long"), "_most"), "_most")}
    )
    drawn = interval_nodes(drawn.filter(F.col(start).isNotNull() & (F.col("_from") <= F.col("_to"))), "_from", "_to", "_nodes")
    cut = drawn.withColumn("_n", F.explode("_nodes")).drop("_least", "_most", "_from", "_to", "_nodes")
    spread = places.withColumn("_n", F.explode(point_nodes(F.col("_at"))))
    node = ["_level", "_node"]
    split = {"_level": F.col("_n.level"), "_node": F.col("_n.node")}
    hits = skew_join(spread.withColumns(split).drop("_n"), cut.withColumns(split).drop("_n"), [*keys, *node], "inner").drop(*node)
    if bare:
        return hits.select(*keys, F.col("_at").cast(points.schema[point].dataType).alias(point), *[c for c in hits.columns if c not in (*keys, "_at")])
    return skew_join(points.withColumn("_at", F.col(point).cast("long")), hits, [*keys, "_at"], "inner").drop("_at")
