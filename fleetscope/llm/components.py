"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least node among the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(stored(least, "stars"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of these. ``a`` is greater than ``b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(stored(least, "stars"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``); the root is the least node of the component.

    Each round is stored; rounds end when neither star changes an edge. One row of sums reaches the driver a round.
    """
    up = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, seen = stored(up, "edges"), None
    while True:
        edges = stored(_small_star(stored(_large_star(edges), "edges")), "edges")
        sums = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if sums == seen:
            break
        seen = sums
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
