"""Insight history of a stream: a state table merged per trigger.

Everything kept per insight (first and last tick, count, peaks, latest values) merges in any
order, so late and shuffled input leads to the batch result. ``resolved_at`` depends on the
report ticks seen so far and is derived when the history is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscope.lineage import keep
from fleetscope.plans.history import LATEST, TITLE_KEY, merge_states, partial_state, resolve

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUP = ["cluster_id"]
KEYS = [*GROUP, *TITLE_KEY]
BODY = [c for c in LATEST if c not in TITLE_KEY]


@dataclass(frozen=True)
class HistoryStream:
    """``root/state/even`` and ``odd`` hold the merged state after the last two batches, ``root/ticks/batch=<id>`` the report
    ticks a batch brought.

    A batch reads the state of the one before and overwrites the older of the two, so a replayed batch counts once and no
    older state piles up. A batch whose forerunner left no state, or another one's, is refused.
    """

    spark: SparkSession
    root: str

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """``rows``: insights, plus one heartbeat row per report tick (``category`` null) so that empty reports count."""
        ticks = rows.select(*GROUP, "tick").distinct()
        ticks.write.mode("overwrite").parquet(f"{self.root}/ticks/batch={batch_id}")
        merged = partial_state(rows.filter(F.col("category").isNotNull()), KEYS, BODY)
        if batch_id > 0:
            merged = merge_states(self.state(batch_id - 1).unionByName(merged), KEYS)
        merged.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(self._state_path(batch_id))

    def _state_path(self, batch_id: int) -> str:
        return f"{self.root}/state/{'odd' if batch_id % 2 else 'even'}"

    def state(self, batch_id: int) -> DataFrame:
        """State after a batch: one of the last two."""
        found = self._read(self._state_path(batch_id)) if self._read(f"{self.root}/ticks/batch={batch_id}") is not None else None
        if found is None or not found.filter(F.col("batch") != batch_id).isEmpty():
            raise ValueError(f"{self.root} holds no state after batch {batch_id}; its insights would be lost")
        return found.drop("batch")

    def start(self, insights: DataFrame, report_ticks: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge a stream of insights and a stream of report ticks (``cluster_id, tick``), which may come without findings."""
        rows = insights.unionByName(report_ticks.select(*GROUP, "tick"), allowMissingColumns=True)
        return rows.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def accumulated(self, batch_id: int) -> DataFrame:
        """The history after a batch, in the shape of ``plans.history.accumulate``."""
        spine = self.spark.read.parquet(f"{self.root}/ticks").filter(F.col("batch") <= batch_id).select(*GROUP, "tick").distinct()
        return resolve(self.state(batch_id), spine, GROUP, TITLE_KEY, BODY)


@dataclass(frozen=True)
class IncrementalHistory:
    """A history whose triggers write only what they changed.

    The merged state lives in the query's state store. A trigger appends the insights it changed, each with its whole
    merged state, to ``root/changes/batch=<id>`` and the report ticks it brought to ``root/ticks/batch=<id>``, so its bytes don't
    depend on the length of the history. A repeated trigger replaces its own files. ``compact`` folds the changes so far
    into ``root/base/through=<id>``; readers take the newest base and what came after it.

    A query that starts anew over a root with later batches has lost its state and is refused.
    """

    spark: SparkSession
    root: str

    def start(self, insights: DataFrame, report_ticks: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge a stream of insights and a stream of report ticks (``cluster_id, tick``), which may come without findings.

        RocksDB keeps the state, and its change log makes a checkpoint as large as the change.
        """
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        self.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        rows = insights.unionByName(report_ticks.select(*GROUP, "tick"), allowMissingColumns=True)
        # a heartbeat's tick is its key, so that reports are told apart and findings merge over ticks
        rows = rows.withColumn("report_tick", F.when(F.col("category").isNull(), F.col("tick")))
        merged = partial_state(rows, [*KEYS, "report_tick"], BODY)
        stream = merged.writeStream.outputMode("update").foreachBatch(self.land)
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def land(self, changed: DataFrame, batch_id: int) -> None:
        later = self._read("ticks")
        if batch_id == 0 and later is not None and not later.filter(F.col("batch") > 0).isEmpty():
            raise ValueError(f"{self.root} holds later batches than a new query; its checkpoint, and with it the state, is lost")
        changed = keep(changed)
        beat = F.col("category").isNull()
        changed.filter(~beat).drop("report_tick").write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        changed.filter(beat).select(*GROUP, F.col("report_tick").alias("tick")).write.mode("overwrite").parquet(f"{self.root}/ticks/batch={batch_id}")
        changed.unpersist()

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _base(self, batch_id: int) -> int:
        """The newest compaction that holds nothing after ``batch_id``; -1 if there is none."""
        done = self._read("base/done")
        found = None if done is None else done.filter(F.col("through") <= batch_id).agg(F.max("through")).first()[0]
        return -1 if found is None else found

    def _since(self, part: str, batch_id: int) -> DataFrame:
        """Rows of ``part`` up to a batch: the newest base, and the batches after it (pruned by folder)."""
        base = self._base(batch_id)
        rows = self._read(part).filter((F.col("batch") > base) & (F.col("batch") <= batch_id))
        return rows if base < 0 else rows.unionByName(self._read(f"base/{part}").filter(F.col("through") == base).drop("through"))

    def state(self, batch_id: int) -> DataFrame:
        """Merged state after a batch: what each insight's last change left."""
        rows = self._since("changes", batch_id)
        values = [c for c in rows.columns if c not in (*KEYS, "batch")]
        last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values, "batch"), "batch").alias("last"))
        return last.select(*KEYS, "last.*")

    def report_ticks(self, batch_id: int) -> DataFrame:
        return self._since("ticks", batch_id).groupBy(*GROUP, "tick").agg(F.min("batch").alias("batch"))

    def compact(self, batch_id: int) -> None:
        """Fold everything up to a batch into one base. Call it now and then; batches at or below the last one aren't read again.

        The base counts once its mark is written, so a broken compaction leaves the history as it was.
        """
        state, ticks = self.state(batch_id), self.report_ticks(batch_id)
        state.write.mode("overwrite").parquet(f"{self.root}/base/changes/through={batch_id}")
        ticks.write.mode("overwrite").parquet(f"{self.root}/base/ticks/through={batch_id}")
        self.spark.range(1).select(F.lit(batch_id).cast("int").alias("through")).write.mode("append").parquet(f"{self.root}/base/done")

    def accumulated(self, batch_id: int) -> DataFrame:
        """The history after a batch, in the shape of ``plans.history.accumulate``."""
        return resolve(self.state(batch_id), self.report_ticks(batch_id).drop("batch"), GROUP, TITLE_KEY, BODY)
