"""Keyed stream state that sees its rows in event-time order, also when files arrive late or shuffled.

Rows wait in the key's buffer until the watermark has passed them; an event-time timer then hands them on in order, and no row that
comes afterwards can belong before them. Rows behind the watermark are dropped by Spark, which counts them (``late_rows``).
State is in RocksDB, per key as large as the buffer and the operator's own state, however long the series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Buffers ``(at_us, place, flag)`` per key; subclasses take rows in order in ``step`` and may name a time to be woken at.

    ``at_us`` is the event time in microseconds, ``place`` breaks ties (a snapshot id, say), ``flag`` is a fact of the row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at_us bigint, place bigint, flag boolean")
        self.own = self.state(handle)

    def state(self, handle: StatefulProcessorHandle) -> object:
        raise NotImplementedError

    def step(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], int | None]:
        """Output rows (without the key) of rows in order, and the time to be woken at without new rows."""
        raise NotImplementedError

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        least = None
        for part in rows:
            self.pending.appendList([tuple(r) for r in part[["at_us", "place", "flag"]].itertuples(index=False)])
            least = int(part["at_us"].min()) if least is None else min(least, int(part["at_us"].min()))
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        due, rest = sorted(r for r in held if r[0] <= passed), [r for r in held if r[0] > passed]
        if due:
            if rest:
                self.pending.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self.pending.clear()
        out, wake = self.step(due, passed)
        if wake is not None:
            self._wake(wake)
        if out:
            columns = list(zip(*out, strict=True))
            yield pd.DataFrame({**{name: [value] * len(out) for name, value in zip(self.keys, key, strict=True)}, **dict(zip(self.names, columns, strict=True))})


def ordered_stream(rows: DataFrame, keys: list[str], at: str, place: str, flag: str | None, processor: Ordered, schema: str, watermark: str) -> DataFrame:
    """What ``processor`` gives for the rows of each key in event-time order. ``schema`` leaves the keys out."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    event = F.col(at).cast("timestamp")
    shown = rows.filter(F.col(at).isNotNull()).select(
        *keys, event.alias("_event"), F.unix_micros(event).alias("at_us"), F.col(place).cast("bigint").alias("place"),
        (F.lit(True) if flag is None else F.col(flag)).alias("flag"),
    )
    processor.keys, processor.names = keys, [part.strip().split()[0] for part in schema.split(",")]
    key_schema = ", ".join(f"{k} {shown.schema[k].dataType.simpleString()}" for k in keys)
    grouped = shown.withWatermark("_event", watermark).groupBy(*keys)
    return grouped.transformWithStateInPandas(processor, f"{key_schema}, {schema}", "append", "eventtime")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, over the triggers whose progress Spark still keeps (``numRecentProgressUpdates``)."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to the Parquet table ``path``, until the input that is there is used up."""
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return sink.trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(path)
