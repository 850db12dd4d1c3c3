"""Results that several branches of a plan read: computed once and kept with the session."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def keep(df: DataFrame) -> DataFrame:
    """``df``, kept in memory or on the executors' disks from its first use.

    Nothing runs and nothing is written to a folder here. Parts lost with an executor are computed
    again from the lineage. ``df.unpersist()`` gives the space back.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def keep_large(df: DataFrame) -> DataFrame:
    """As ``keep``, on the executors' disks alone: for results that grow with the events, of which memory would hold a small part.

    What ``keep`` has in memory are pieces of a little over 1 MB, each of which fills two of the JVM collector's regions in a heap below 2 GB.
    Executors may so run out of heap before their storage counts as full and moves to disk.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder, else its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the session's checkpoint folder, so that plans built on it start anew.

    Where no folder is set (a session of its own, as in tests) one in the warehouse is used. Spark removes the files with the
    session's references to them, if told so (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint()
