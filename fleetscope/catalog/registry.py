"""Registration of a query together with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.catalog.oracle_base import compose
from fleetscope.sources.sample_views import SampleViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, instead: dict[str, str] | None = None):
    """Register ``fn(views)`` as ``name``; ``oracle`` is a statement over the CTEs of ``oracle_base``, some of them replaced."""

    def add(fn: Callable[[SampleViews], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(SampleViews(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = compose(oracle, instead)
        return fn

    return add


def r6(name: str, out: str | None = None):
    """Metric rounded to six places, as the SQL side rounds it."""
    return F.round(F.col(name).cast("double"), 6).alias(out or name)
