"""Mixing to target shares by iterative proportional fitting (raking), then sampling by calibrated probabilities.

Tokens are summed for each cell (one value of every margin). Raking scales the cells' weights to the target shares of one
margin after the other until all margins fit within ``tolerance``. Fitted weights keep the association between margins that the
data has. Only cells move between rounds; each round is one stored table, and single sums (the largest misfit) reach the driver.

A document's expected copies are its cell's fitted share over its tokens, times the token budget, given in tokens or as a share
of the input's. Where they exceed 1, the whole part are sure copies, the rest is drawn. Without a budget it is the largest for
which none exceeds 1, so the rarest cell decides how little of all the others is drawn; give one wherever a corpus is to last. The draw is a hash of doc_id and a seed, so a repeated task draws alike, at any partitioning.

Defined results: a null margin is a value of its own (``(null)``); targets of values that don't occur are shared out among
the rest, values without a target get none; a cell of weight 0 has probability 0; documents without tokens take their
cell's probability; rows with equal doc_id are drawn alike; an empty table gives no rows. Columns of the input are kept, except those named like a result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import stored

NULL = "(null)"
ROUNDS = 50
TOLERANCE = 1e-6


def shares(cells: DataFrame, margin: str, power: float = 1.0, weight: str = "tokens") -> DataFrame:
    """``value, share`` of a margin, proportional to its tokens to a power; below 1 the large shrink in favour of the small."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum(weight).cast("double"), F.lit(power)).alias("share"))
    return _normal(sums)


def _normal(targets: DataFrame) -> DataFrame:
    total = targets.agg(F.sum("share")).first()[0] or 0.0
    return targets.select("value", F.try_divide("share", F.lit(float(total))).alias("share"))


def _misfit(cells: DataFrame, targets: Mapping[str, DataFrame]) -> float:
    worst = None
    for margin, wanted in targets.items():
        sums = cells.groupBy(margin).agg(F.sum("weight").alias("_sum"))
        one = sums.join(wanted.toDF(margin, "_share"), margin).select(F.abs(F.col("_sum") - F.col("_share")).alias("off"))
        worst = one if worst is None else worst.union(one)
    return worst.agg(F.coalesce(F.max("off"), F.lit(0.0))).first()[0]


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins and ``tokens``) with ``weight``: their shares after fitting. ``targets``: by margin ``value, share``."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = stored(cells.withColumn("weight", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.lit(total)), F.lit(0.0))), "raked")
    wanted = {}
    for margin, given in targets.items():
        there = fitted.filter("weight > 0").select(F.col(margin).alias("value")).distinct()
        wanted[margin] = stored(_normal(given.select("value", F.col("share").cast("double").alias("share")).join(there, "value")), "targets")
    for _ in range(rounds):
        step = fitted
        for margin, shared in wanted.items():
            sums = step.groupBy(margin).agg(F.sum("weight").alias("_sum")).join(shared.toDF(margin, "_share"), margin, "left")
            factor = sums.select(margin, F.coalesce(F.try_divide("_share", "_sum"), F.lit(0.0)).alias("_factor"))
            step = step.join(factor, margin).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
        fitted = stored(step.select(*fitted.columns), "raked")
        if _misfit(fitted, wanted) <= tolerance:
            break
    return fitted


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(1 << 53))


def mix_to_targets(
    docs: DataFrame,
    margins: Mapping[str, Column],
    tokens: Column,
    powers: Mapping[str, float] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    budget: float | None = None,
    seed: int = 0,
    id_column: str = "doc_id",
    budget_share: float | None = None,
) -> DataFrame:
    """``docs`` with ``tokens``, ``probability`` (expected copies) and ``copies`` (drawn).

    ``margins``: name and expression. A margin's target comes from ``targets``, or from its own shares to a power in ``powers``.
    ``budget``: expected tokens of all copies; ``budget_share``: the same as a share of the tokens of ``docs``. At most one is given.
    """
    if budget is not None and budget_share is not None:
        raise ValueError("give budget or budget_share, not both")
    docs = docs.drop("tokens", "probability", "copies")
    named = {f"_margin_{m}": F.coalesce(c.cast("string"), F.lit(NULL)) for m, c in margins.items()}
    marked = docs.withColumns(named | {"tokens": F.coalesce(tokens.cast("long"), F.lit(0))})
    cells = stored(marked.groupBy(*named).agg(F.sum("tokens").alias("tokens")), "cells")
    aims = {f"_margin_{m}": (targets or {}).get(m) for m in margins}
    aims = {m: aim if aim is not None else shares(cells, m, (powers or {}).get(m.removeprefix("_margin_"), 1.0)) for m, aim in aims.items()}
    fitted = rake(cells, aims)
    if budget_share is not None:
        budget = budget_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    ratio = fitted.withColumn("_ratio", F.coalesce(F.try_divide("weight", F.col("tokens").cast("double")), F.lit(0.0)))
    scale = F.lit(float(budget)) if budget is not None else F.try_divide(F.lit(1.0), F.lit(ratio.agg(F.max("_ratio")).first()[0] or 0.0))
    chances = ratio.select(*named, F.coalesce(F.col("_ratio") * scale, F.lit(0.0)).alias("probability"))
    drawn = marked.join(stored(chances, "chances"), list(named))
    copies = F.floor(F.col("probability") + uniform(id_column, seed=seed)).cast("int")
    return drawn.select(*docs.columns, "tokens", "probability", copies.alias("copies"))
