"""Keyed stream state over polls: minimum gap, capped buffers and histories, staleness with timers, once-only reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from fleetscope import thresholds as T
from fleetscope.operators.series import SLOT
from fleetscope.streaming.ordered import Ordered, ordered_stream

WATERMARK = "2 minutes"


class MinimumGap(Ordered):
    """Keeps a row if it is ``gap_us`` or more after the last kept one; the state is that row's time."""

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def state(self, handle: StatefulProcessorHandle) -> object:
        return handle.getValueState("last", "at_us bigint")

    def step(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], int | None]:
        last = self.own.get()[0] if self.own.exists() else None
        kept = []
        for at, _, _ in rows:
            if last is None or at >= last + self.gap_us:
                kept.append((at // 1_000_000,))
                last = at
        if kept:
            self.own.update((last,))
        return kept, None


class Ring(Ordered):
    """For each row how many of the last ``size`` the buffer holds and the place of the oldest.

    The places lie in a map of ``size`` slots, so a row costs one read and one write, not a copy of the buffer.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def state(self, handle: StatefulProcessorHandle) -> object:
        self.slots = handle.getMapState("slots", "slot bigint", "place bigint")
        return handle.getValueState("count", "n bigint")

    def step(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], int | None]:
        n, out = self.own.get()[0] if self.own.exists() else 0, []
        for _, place, _ in rows:
            self.slots.updateValue((n % self.size,), (place,))
            n += 1
            oldest = self.slots.getValue((n % self.size if n >= self.size else 0,))[0]
            out.append((place, min(n, self.size), oldest))
        if rows:
            self.own.update((n,))
        return out, None


class Freshness(Ordered):
    """A row for each change between fresh and stale: at a poll, or when the last good one has become too old with none coming.

    The state is the time of the last good poll and whether the slot is stale.
    """

    def __init__(self, age_us: dict[str, int], other_us: int) -> None:
        self.age_us, self.other_us = age_us, other_us

    def state(self, handle: StatefulProcessorHandle) -> object:
        return handle.getValueState("slot", "good_us bigint, age_us bigint, stale boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802
        if not self.own.exists():
            self.own.update((None, self.age_us.get(key[1], self.other_us), None))
        return super().handleInputRows(key, rows, timerValues)

    def step(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], int | None]:
        good, age, stale = self.own.get()
        out = []
        for at, _, ok in [*rows, (until_us, None, None)]:
            if stale is False and at > good + age:
                stale = True
                out.append((good + age + 1, True, "age"))
            if ok is not None and stale is not (not ok):
                stale = not ok
                out.append((at, stale, "poll"))
            good = at if ok else good
        self.own.update((good, age, stale))
        return out, None if stale is not False else good + age + 1000


def throttle_stream(polls: DataFrame, gap: int, watermark: str = WATERMARK) -> DataFrame:
    """Polls (``cluster_id, slot, poll_ts``) kept at least ``gap`` seconds apart, as ``at_s``."""
    seconds = F.timestamp_seconds(F.floor(F.unix_micros(F.col("poll_ts").cast("timestamp")) / 1_000_000))
    timed = polls.select(*SLOT, seconds.alias("poll_ts"), F.lit(0).alias("place"))
    return ordered_stream(timed, SLOT, "poll_ts", "place", None, MinimumGap(gap * 1_000_000), "at_s bigint", watermark)


def ring_buffer_stream(polls: DataFrame, size: int = T.RING_SIZE, watermark: str = WATERMARK) -> DataFrame:
    """For each good poll (``cluster_id, slot, poll_ts, snapshot_id``) how many snapshots the buffer holds and the oldest one's id."""
    schema = "snapshot_id bigint, buffered bigint, oldest_id bigint"
    return ordered_stream(polls, SLOT, "poll_ts", "snapshot_id", None, Ring(size), schema, watermark)


def history_cap_stream(points: DataFrame, cap: int = T.HISTORY_CAP, watermark: str = WATERMARK) -> DataFrame:
    """For each point (``cluster_id, poll_ts, tick``) how many points its cluster's capped history holds and the tick of the oldest."""
    schema = "tick bigint, held bigint, oldest_tick bigint"
    return ordered_stream(points, ["cluster_id"], "poll_ts", "tick", None, Ring(cap), schema, watermark)


def newest_of(points: DataFrame, marks: DataFrame) -> DataFrame:
    """The points in the capped history after the last of ``marks`` (rows of ``history_cap_stream``)."""
    last = marks.groupBy("cluster_id").agg(F.max_by("oldest_tick", "tick").alias("_from"), F.max("tick").alias("_upto"))
    return points.join(last, "cluster_id").filter((F.col("tick") >= F.col("_from")) & (F.col("tick") <= F.col("_upto"))).drop("_from", "_upto")


def freshness_stream(polls: DataFrame, intervals_s: dict[str, int], other_s: int, watermark: str = WATERMARK) -> DataFrame:
    """Changes of each slot between fresh and stale (``cluster_id, slot, at_us, stale, cause``) from polls (with ``ok``).

    A slot is stale after a failed poll, and once its last good poll is older than twice its interval; a timer tells so as
    soon as the watermark says that nothing newer came.
    """
    ages = {slot: int(s * T.STALE_FACTOR * 1_000_000) for slot, s in intervals_s.items()}
    processor = Freshness(ages, int(other_s * T.STALE_FACTOR * 1_000_000))
    return ordered_stream(polls, SLOT, "poll_ts", "snapshot_id", "ok", processor, "at_us bigint, stale boolean, cause string", watermark)


def stale_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """``cluster_id, slot, stale`` of each slot at ``as_of``, from the table of changes."""
    upto = changes.filter(F.col("at_us") <= F.unix_micros(as_of.cast("timestamp")))
    return upto.groupBy(*SLOT).agg(F.max_by("stale", F.struct("at_us", F.col("cause") == "poll")).alias("stale"))


def once_per_report(reports: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A report is fed on once per cluster and time, also when it is delivered again."""
    return reports.withWatermark("poll_ts", watermark).dropDuplicatesWithinWatermark(["cluster_id", "poll_ts"])
