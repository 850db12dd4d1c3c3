"""Blocks of near equal numbers of rows along an order, whatever the rows' times and keys are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.lineage import keep


def equal_blocks(df: DataFrame, keys: list[str], order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``, the number of the row's block; numbers rise along ``keys``, then ``order``.

    Spark samples the rows to cut the whole order, not each key's, into ranges of equal rows, so neither a hot key nor a crowded
    moment makes a large block (only rows equal in all of ``keys`` and ``order`` stay together). The rows are kept from their first use, since another
    sample would cut elsewhere; rows lost with an executor are read again by the cuts that were made.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return keep(ranged.withColumn(out, F.spark_partition_id()))
