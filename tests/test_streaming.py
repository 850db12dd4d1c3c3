"""Streams end with the batch result, also for shuffled and late files."""

from __future__ import annotations

import tempfile

import pytest

from pyspark.sql import functions as F

from fleetscope.catalog.all_queries import QUERIES
from fleetscope.operators import series
from fleetscope.operators.throttle import throttle
from fleetscope.plans.history import TITLE_KEY, accumulate
from fleetscope.plans.report import DiagnosticPlan
from fleetscope.schemas import KEY, conform
from fleetscope.plans.insights import SCHEMAS
from fleetscope.sources.sample_views import SampleViews
from fleetscope.streaming import ordered, state
from fleetscope.streaming.history import HistoryStream, IncrementalHistory
from fleetscope.streaming.reports import TICKED, ReportStream
from fleetscope.streaming.rules import row_findings, row_rules

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = q.option("checkpointLocation", tempfile.mkdtemp(prefix="fs-ck-")).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def land(df, folder, order):
    """Write ``df`` as several files, one per value of ``order``."""
    df.repartition(4, order).write.mode("append").parquet(folder)


def test_row_rules_on_a_stream(spark):
    v = SampleViews(spark, SF)
    folder = tempfile.mkdtemp(prefix="fs-in-")
    table = conform(v.stages, SCHEMAS["stages"])
    land(table, folder, F.col("stage_id"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    columns = [*KEY, "rule", "severity", "affected_entity", "title"]
    assert rows(run(row_findings(stream, "stage").select(*columns), "row_rules")) == rows(row_findings(table, "stage").select(*columns))
    assert {r.name for r in row_rules("stage")} >= {"memory_spill", "shuffle_bottleneck", "stage_retries"}
    assert "partition_issues" not in {r.name for r in row_rules("stage")}


def test_reports_with_late_and_shuffled_files(spark):
    v = SampleViews(spark, SF)
    inbox, out, checkpoint = (tempfile.mkdtemp(prefix="fs-rep-") for _ in range(3))
    source = {"executors": v.executors, "stages": v.stages, "jobs": v.jobs, "sql_queries": v.sql_queries}
    conform(v.rdds, SCHEMAS["rdds"]).write.mode("overwrite").parquet(f"{inbox}/rdds")
    conform(v.clusters, SCHEMAS["clusters"]).write.mode("overwrite").parquet(f"{inbox}/clusters")
    reports = ReportStream(spark, inbox, out)
    late = F.col("tick") % 10 == 2  # second quarters arrive last
    for part in (~late, late):
        for t in TICKED:
            conform(source[t], SCHEMAS[t]).filter(part).write.mode("append").parquet(f"{inbox}/{t}")
        reports.start(checkpoint).awaitTermination()
    columns = [*KEY, "score", "insights", "critical", "warning", "top_title"]
    assert rows(reports.report().select(*columns)) == rows(DiagnosticPlan(v.telemetry).report.select(*columns))


def test_history_merges_in_any_order(spark):
    p = DiagnosticPlan(SampleViews(spark, SF).telemetry, rules=[r for r in DiagnosticPlan(SampleViews(spark, SF).telemetry).rules if r.ordinal in (1, 9, 18)])
    found, spine = p.insights.cache(), p.spine.cache()
    beat = spine.select(*KEY, *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name not in KEY])
    rows_in = found.unionByName(beat)
    stream = HistoryStream(spark, tempfile.mkdtemp(prefix="fs-hist-"))
    for batch, part in enumerate((F.col("tick") % 3 == 1, F.col("tick") % 3 == 0, F.col("tick") % 3 == 2)):
        stream.merge(rows_in.filter(part), batch)
    stream.merge(rows_in.filter(F.col("tick") % 3 == 2), 2)  # a replayed batch counts once
    batch = accumulate(found, spine, ["cluster_id"])
    assert rows(stream.accumulated(2).select(*batch.columns)) == rows(batch)
    found.unpersist(), spine.unpersist()


def test_history_attached_to_a_stream(spark):
    p = DiagnosticPlan(SampleViews(spark, SF).telemetry, rules=[r for r in DiagnosticPlan(SampleViews(spark, SF).telemetry).rules if r.ordinal in (1, 9)])
    found, spine = p.insights.cache(), p.spine.cache()
    folders = [tempfile.mkdtemp(prefix="fs-at-") for _ in range(4)]
    late = F.col("tick") % 3 == 1
    stream = HistoryStream(spark, folders[2])
    for n, part in enumerate((~late, late)):
        found.filter(part).coalesce(1).write.mode("append").parquet(folders[0])
        spine.filter(part).coalesce(1).write.mode("append").parquet(folders[1])
        read = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f) for df, f in ((found, folders[0]), (spine, folders[1]))]
        stream.start(*read, folders[3]).awaitTermination()
    last = max(r.batch for r in spark.read.parquet(f"{folders[2]}/ticks").select("batch").distinct().collect())
    want = accumulate(found, spine, ["cluster_id"])
    assert last >= 1 and rows(stream.accumulated(last).select(*want.columns)) == rows(want)
    for start in (last + 2, last + 3):
        with pytest.raises(ValueError, match="holds no state"):
            stream.merge(found, start)
    found.unpersist(), spine.unpersist()


def test_incremental_history_equals_batch_and_writes_what_changed(spark):
    p = DiagnosticPlan(SampleViews(spark, SF).telemetry, rules=[r for r in DiagnosticPlan(SampleViews(spark, SF).telemetry).rules if r.ordinal in (1, 9, 18)])
    found, spine = p.insights.cache(), p.spine.cache()
    inbox, beats, root, checkpoint = (tempfile.mkdtemp(prefix="fs-inc-") for _ in range(4))
    stream = IncrementalHistory(spark, root)

    def go(part, to=checkpoint):
        found.filter(part).coalesce(1).write.mode("append").parquet(inbox)
        spine.filter(part).coalesce(1).write.mode("append").parquet(beats)
        read = [spark.readStream.schema(df.schema).parquet(f) for df, f in ((found, inbox), (spine, beats))]
        stream.start(*read, to).awaitTermination()
        return max(r.batch for r in spark.read.parquet(f"{root}/ticks").select("batch").distinct().collect())

    late, one = F.col("tick") % 3 == 1, F.col("tick") == spine.agg(F.min("tick")).first()[0]
    want = accumulate(found, spine, ["cluster_id"])
    columns = want.columns
    first = go(~late & ~one)
    early = ~late & ~one
    assert rows(stream.accumulated(first).select(*columns)) == rows(accumulate(found.filter(early), spine.filter(early), ["cluster_id"]).select(*columns))
    second = go(late & ~one)
    stream.compact(second)
    last = go(one)
    assert rows(stream.accumulated(last).select(*columns)) == rows(want)
    # the last trigger brought one tick: it wrote that tick's insights, not the history
    changed = spark.read.parquet(f"{root}/changes/batch={last}")
    touched = found.filter(one).select("cluster_id", *TITLE_KEY).distinct().count()
    assert 0 < changed.count() == touched < stream.state(last).count()
    assert spark.read.parquet(f"{root}/ticks/batch={last}").count() == spine.filter(one).count()
    # from the base on, and before it
    assert rows(stream.accumulated(second).select(*columns)) == rows(accumulate(found.filter(~one), spine.filter(~one), ["cluster_id"]).select(*columns))
    assert rows(stream.accumulated(first).select(*columns)) == rows(accumulate(found.filter(early), spine.filter(early), ["cluster_id"]).select(*columns))
    with pytest.raises(Exception, match="is lost"):
        go(one, tempfile.mkdtemp(prefix="fs-new-"))
    found.unpersist(), spine.unpersist()


def shuffled(df, seconds):
    """``df`` in six files that overlap in time, and a last poll of no one's that moves the watermark past all others."""
    folder = tempfile.mkdtemp(prefix="fs-poll-")
    df = df.withColumn("poll_ts", F.col("poll_ts").cast("timestamp"))
    end = df.agg(F.max("poll_ts") + F.make_interval(secs=F.lit(seconds))).first()[0]
    for n in range(6):
        df.filter(F.pmod(F.xxhash64("snapshot_id"), F.lit(6)) == n).coalesce(1).write.mode("append").parquet(folder)
    columns = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(df.columns, ("nobody", "none", end, 10**9, True))]
    df.sparkSession.range(1).select(*columns).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def landed(stream):
    """The table that the stream fills, and its query."""
    out, checkpoint = tempfile.mkdtemp(prefix="fs-out-"), tempfile.mkdtemp(prefix="fs-ck-")
    query = ordered.append_to(stream, out, checkpoint)
    query.awaitTermination()
    return ordered.read_table(stream.sparkSession, out, stream).filter("cluster_id <> 'nobody'"), query


POLL = ["cluster_id", "slot", "poll_ts", "snapshot_id", "ok"]


def test_ordered_state_of_shuffled_files_equals_batch(spark):
    v = SampleViews(spark, SF)
    polls = v.view("polls").filter("cluster_id = 'c0'").select(*POLL)
    good = polls.filter("ok")
    ring, query = landed(state.ring_buffer_stream(shuffled(good, 41 * 86400), watermark="40 days"))
    want = QUERIES["ring_buffer_stream"](spark, SF).filter("cluster_id = 'c0'")
    assert rows(ring) == rows(want.select(*ring.columns)) and ordered.late_rows(query) == 0
    kept, _ = landed(state.throttle_stream(shuffled(good, 41 * 86400), 21600, watermark="40 days"))
    at = F.expr("cast(unix_seconds(cast(poll_ts as timestamp)) as bigint)")
    assert rows(kept) == rows(throttle(good.withColumn("at_s", at), ["cluster_id", "slot"], "at_s", 21600).select("cluster_id", "slot", "at_s"))


def test_rows_behind_the_watermark_are_counted(spark):
    polls = [("c", "s", f"2024-01-01 0{h}:00:00", h, True) for h in range(1, 8)]
    order = [1, 5, 6, 2, 7]
    folder = tempfile.mkdtemp(prefix="fs-late-")
    frame = spark.createDataFrame(polls, "cluster_id string, slot string, poll_ts string, snapshot_id long, ok boolean").withColumn("poll_ts", F.col("poll_ts").cast("timestamp"))
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    out, checkpoint = tempfile.mkdtemp(prefix="fs-out-"), tempfile.mkdtemp(prefix="fs-ck-")
    late = 0
    for h in order:  # one trigger each, so that the watermark has moved on before hour 2 arrives
        frame.filter(F.col("snapshot_id") == h).coalesce(1).write.mode("append").parquet(folder)
        query = ordered.append_to(state.ring_buffer_stream(stream, 3), out, checkpoint)
        query.awaitTermination()
        late += ordered.late_rows(query)
    got = ordered.read_table(spark, out, state.ring_buffer_stream(stream, 3))
    assert late == 1 and sorted((r.snapshot_id, r.buffered, r.oldest_id) for r in got.collect()) == [(1, 1, 1), (5, 2, 1), (6, 3, 1)]


def test_history_cap_on_a_stream_equals_batch(spark):
    ticks = spark.range(90).select(
        (F.concat(F.lit("c"), (F.col("id") % 2).cast("string"))).alias("cluster_id"), F.lit("s").alias("slot"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 15).alias("poll_ts"), F.col("id").alias("snapshot_id"), F.lit(True).alias("ok"),
    )
    stream = shuffled(ticks, 7200).withColumnRenamed("snapshot_id", "tick")
    marks, _ = landed(state.history_cap_stream(stream, 20, watermark="1 hour"))
    points = ticks.withColumnRenamed("snapshot_id", "tick").select("cluster_id", "tick", F.col("tick").alias("value"))
    want = series.newest_points(points, "value", 20).select("cluster_id", "tick", "value")
    assert marks.count() == 90 and rows(state.newest_of(points, marks).select("cluster_id", "tick", "value")) == rows(want)


def test_staleness_by_timers_equals_batch_at_any_time(spark):
    polls = SampleViews(spark, SF).view("polls").filter("cluster_id = 'c4' and slot in ('executors', 'cluster')").select(*POLL)
    intervals, other = {"executors": 7200}, 36000
    changes, _ = landed(state.freshness_stream(shuffled(polls, 80 * 86400), intervals, other, watermark="40 days"))
    assert changes.filter("cause = 'age' and stale").count() > 0
    ends = polls.agg(F.min("poll_ts"), F.max("poll_ts")).first()
    interval = F.when(F.col("slot") == "executors", 7200).otherwise(other)
    for share in (0.1, 0.37, 0.5, 0.81, 1.0, 1.2):
        at = F.lit(ends[0] + (ends[1] - ends[0]) * share)
        want = series.staleness(polls, at, interval).select("cluster_id", "slot", "stale")
        assert rows(state.stale_at(changes, at).select("cluster_id", "slot", "stale")) == rows(want), share


def test_a_report_is_fed_once(spark):
    polls = SampleViews(spark, SF).view("polls").select("cluster_id", F.col("poll_ts").cast("timestamp").alias("poll_ts")).limit(200)
    folder = tempfile.mkdtemp(prefix="fs-dup-")
    polls.union(polls).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(polls.schema).parquet(folder)
    assert run(state.once_per_report(stream, "40 days"), "once").count() == polls.distinct().count()
