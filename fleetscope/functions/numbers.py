"""Ratios with a defined value when the denominator is not positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope import thresholds as T


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0.0 unless ``den > 0``."""
    return F.when(den > 0, F.try_divide(num.cast("double"), den.cast("double"))).otherwise(F.lit(0.0))


def clamp100(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def whole(value: Column) -> Column:
    """Integer part toward zero; the rounding first removes noise of the last bits."""
    return F.round(value, 9).cast("int")


def is_skewed(p50: Column, maximum: Column, bound: float = T.TASK_SKEW_RATIO) -> Column:
    """Largest value at least ``bound`` times the median; any positive maximum if the median is not."""
    return F.when(p50 <= 0, maximum > 0).otherwise(F.try_divide(maximum, p50) >= bound)


def is_gc_pressure(gc_ms: Column, run_ms: Column, bound: float = T.TASK_GC_RATIO) -> Column:
    return F.when(run_ms <= 0, F.lit(False)).otherwise(F.try_divide(gc_ms.cast("double"), run_ms) >= bound)


def slots(max_tasks: Column, cores: Column) -> Column:
    """Task slots of an executor: its limit when given, else its cores."""
    return F.when(max_tasks > 0, max_tasks).otherwise(cores)


def jvm_heap_estimate(max_memory: Column, jvm_used: Column) -> Column:
    """Heap size guessed from the storage limit, never below what is used."""
    return F.greatest((max_memory / T.STORAGE_SHARE_OF_HEAP).cast("long"), jvm_used)


def memory_pct(heap: Column, off_heap: Column, used: Column, max_memory: Column) -> Column:
    """JVM share when a peak is known, else the storage share."""
    jvm = heap + off_heap
    return F.when(
        (jvm > 0) & (max_memory > 0), F.try_divide(jvm.cast("double"), jvm_heap_estimate(max_memory, jvm)) * 100.0
    ).otherwise(ratio(used, max_memory) * 100.0)
