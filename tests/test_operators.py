"""Skew-safe operators against plain Python, with bounds small enough that every splitting path runs."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from fleetscope.operators import blocks, sketches, skew, timeline
from fleetscope.operators.quantiles import task_quantiles
from fleetscope.operators.throttle import throttle
from fleetscope.plans.history import accumulate, episodes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_skew_join_leaves_both_sides_to_be_split(spark):
    big = frame(spark, [("hot" if i % 3 else f"k{i % 7}", i) for i in range(900)], "k string, pos long")
    small = frame(spark, [("hot", 1), ("k0", 2), ("k1", 3), ("hot", 4)], "k string, v long").groupBy("k").agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = skew.skew_join(big, small, ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ENSURE_REQUIREMENTS") >= 3  # the aggregate's own exchange, and one on each side of the join
    want = big.join(small, "k", "left").select("k", "pos", "v")
    assert sorted(map(str, joined.select("k", "pos", "v").collect())) == sorted(map(str, want.collect()))


def test_exact_median(spark):
    random.seed(3)
    rows = [(k, random.choice([1, 2, 5, 10**6, 10**12 + random.randrange(9)])) for k in "abcd" for _ in range(random.randrange(1, 60))]
    got = {r.k: (r.m, r.m_n) for r in skew.exact_median(frame(spark, rows, "k string, v long"), ["k"], "v", "m").collect()}
    for k in "abcd":
        values = [v for x, v in rows if x == k]
        assert got[k] == (float(statistics.median(values)), len(values))


def test_dense_number(spark):
    rows = [("a" if i % 5 else "b", i * 37 % 101, i) for i in range(300)]
    df = frame(spark, rows, "k string, v long, i long")
    got = skew.dense_number(df, ["k"], [F.col("v").desc(), F.col("i").asc()], [-F.floor(F.col("v") / 7)], "n").collect()
    for k in "ab":
        mine = [r.i for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)]
        assert mine == [i for _, v, i in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))]
        assert sorted(r.n for r in got if r.k == k) == list(range(1, len(mine) + 1))


def test_timeline_operators(spark):
    random.seed(5)
    times = sorted(random.sample(range(500), 120))
    rows = [("s", t, random.choice([None, t * 10])) for t in times]
    df = frame(spark, rows, "k string, t long, v long")
    block = F.floor(F.col("t") / 20)
    prev = {r.t: r.x for r in timeline.previous(df, ["k"], ["t"], block, F.col("v"), "x").collect()}
    nxt = {r.t: r.x for r in timeline.following(df, ["k"], ["t"], block, F.col("t"), "x").collect()}
    last = {r.t: r.x for r in timeline.last_known(df, ["k"], ["t"], block, F.col("v"), "x").collect()}
    ahead = {r.t: r.x for r in timeline.next_known(df, ["k"], ["t"], block, F.col("v"), "x").collect()}
    index = timeline.numbered(df, ["k"], ["t"], block)
    slid = {r.t: (r.n, r.lo) for r in timeline.sliding(index, ["k"], "idx", 6, {"n": F.count("t"), "lo": F.min("t")}, span=16).collect()}
    known = None
    for i, (_, t, v) in enumerate(rows):
        known = v if v is not None else known
        assert prev[t] == (rows[i - 1][2] if i else None)
        assert nxt[t] == (times[i + 1] if i + 1 < len(times) else None)
        assert last[t] == known
        assert ahead[t] == next((x for _, _, x in rows[i:] if x is not None), None)
        assert slid[t] == (min(i + 1, 6), times[max(0, i - 5)])


def greedy(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t >= kept[-1] + gap:
            kept.append(t)
    return kept


def test_throttle_equals_greedy(spark):
    random.seed(11)
    series = {"fixed": [0, 5, 29, 30, 45, 59, 60, 61, 95], "one": [7]}
    for n in range(12):
        series[f"r{n}"] = [random.randrange(0, 4000) for _ in range(random.randrange(1, 400))]
    series["gaps"] = [x for base in (0, 10_000, 10_050, 90_000) for x in range(base, base + 200, 7)]
    df = frame(spark, [(k, t) for k, ts in series.items() for t in ts], "run string, ts long")
    df = df.unionByName(frame(spark, [("one", None), (None, 5)], "run string, ts long"))
    for gap in (30, 1):
        out = {}
        for r in throttle(df, ["run"], "ts", gap).collect():
            out.setdefault(r.run, []).append(r.ts)
        assert {k: sorted(v) for k, v in out.items()} == {k: greedy(ts, gap) for k, ts in series.items()}
    assert greedy(series["fixed"], 30) == [0, 30, 60, 95]


def test_throttle_of_a_million_polls_of_one_slot_over_fifty_tasks(spark):
    polls = spark.range(0, 1_000_000, 1, 50).select(F.lit("slot").alias("run"), (F.col("id") * 3 + F.col("id") % 2).alias("ts"))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    kept = sorted(r.ts for r in throttle(polls, ["run"], "ts", 20_000).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.catalog.clearCache()
    assert kept == greedy([i * 3 + i % 2 for i in range(1_000_000)], 20_000)


def test_blocks_are_equal_for_one_key_one_day_and_one_tick(spark):
    rows = spark.range(0, 60_000).select(F.lit("c").alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), ((F.col("id") * 7919) % 60_000).alias("i"))
    blocked = blocks.equal_blocks(rows, ["k"], [F.col("ts").asc(), F.col("i").asc()], "b", 12)
    found = blocked.groupBy("b").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).orderBy("b").collect()
    assert len(found) == 12 and max(r.n for r in found) < 2 * 60_000 / 12
    assert all(a.hi < b.lo for a, b in zip(found, found[1:]))
    placed = skew.dense_number(rows, ["k"], [F.col("ts").asc(), F.col("i").asc()], None, "n")
    assert placed.filter("n <> i + 1").count() == 0 and placed.count() == 60_000
    spark.catalog.clearCache()


def test_quantiles(spark):
    random.seed(2)
    values = [random.choice([0, 0, 3, -7, 50, 10**9]) + random.randrange(40) for _ in range(97)]
    rows = [("s", (v,)) for v in values] + [("s", (None,))] * 9 + [("t", (None,))] * 3 + [("u", (v,)) for v in (1, 2, 3)] + [("u", (None,))] * 2
    cuts = [min(values), *statistics.quantiles(values, n=4, method="inclusive"), max(values)]
    df = frame(spark, rows, "stage string, metrics struct<run:long>")
    found = task_quantiles(df, ["stage"], {"run": "run"})
    got = {r.stage: [r[f"run_q{q}"] for q in (0, 25, 50, 75, 100)] for r in found.collect()}
    assert got == {"s": cuts, "t": [None] * 5, "u": [1, 1.5, 2, 2.5, 3]}


def test_sketches_merge_within_the_stated_rank_error(spark):
    random.seed(3)
    rows = [("big", i % 7, (random.choice([0, 5, 10**12]) + random.randrange(3000),)) for i in range(40_000)]
    rows += [("ties", 0, (4,))] * 30 + [("none", 0, (None,))] * 3 + [("few", 0, (v,)) for v in (9, -1, 3)]
    df = frame(spark, rows, "cluster string, stage int, metrics struct<run:long>")
    run = {"run": "run"}
    stages = sketches.sketch(df, ["cluster", "stage"], run, size=64)
    merged = sketches.merge(sketches.sketch(df, ["cluster", "stage"], run), ["cluster"], ["run"])
    got = sketches.read_quantiles(merged, ["cluster"], metrics=["run"])
    values = {c: [r.value for r in got.filter(F.col("cluster") == c).orderBy("point").collect()] for c in ("ties", "none", "few")}
    assert values == {"ties": [4] * 5, "none": [None] * 5, "few": [-1, -1, 3, 9, 9]}
    counts = sketches.value_counts(df, ["cluster"], run)
    errors = sketches.rank_errors(got, counts, ["cluster"])
    assert errors.count() == 20 and errors.filter(F.col("error") > sketches.RANK_ERROR).count() == 0
    # the check itself finds a wrong value, and a sketch stays small whatever it has seen
    wrong = got.withColumn("value", F.col("value") + F.lit(10**13))
    assert sketches.rank_errors(wrong, counts, ["cluster"]).filter("cluster = 'big' and point < 1 and error < 0.2").count() == 0
    assert stages.filter(F.length("run") > 4096).count() == 0
    assert sketches.merge(stages.filter("false"), ["cluster"], ["run"]).count() == 0


INSIGHT = (
    "cluster_id string, tick int, category string, affected_entity string, title string, severity string, severity_rank int, metric_value double,"
    "threshold_value double, description string, recommendation string, detector int, rank_metric double, phase int, pos long, slot int, rule string"
)


def insight(tick, title, severity, metric):
    rank = ["CRITICAL", "WARNING", "INFO"].index(severity)
    return ("c", tick, "GC", "e", title, severity, rank, metric, 1.0, "d", "r", 1, 0.0, 0, 0, 0, "gc")


def test_history_resolves_and_reopens(spark):
    """``a`` at 1, 2, 5; ``b`` at 1 only; report ticks 1, 2, 3 (empty), 5, 6 (empty)."""
    found = frame(spark, [insight(1, "a", "WARNING", 3.0), insight(2, "a", "CRITICAL", 2.0), insight(5, "a", "WARNING", 1.0), insight(1, "b", "INFO", 1.0)], INSIGHT)
    spine = frame(spark, [("c", t) for t in (1, 2, 3, 5, 6)], "cluster_id string, tick int")
    acc = {r.title: r for r in accumulate(found, spine, ["cluster_id"]).collect()}
    a, b = acc["a"], acc["b"]
    assert (a.first_seen, a.last_seen, a.resolved_at, a.occurrence_count) == (1, 5, 6, 3)
    assert (a.severity, a.peak_severity, a.metric_value, a.peak_metric_value) == ("WARNING", "CRITICAL", 1.0, 3.0)
    assert (b.last_seen, b.resolved_at) == (1, 2)
    open_now = accumulate(found, spine.filter("tick < 6"), ["cluster_id"]).filter("title = 'a'").collect()[0]
    assert open_now.resolved_at is None
    got = sorted((r.title, r.episode, r.opened, r.last_tick, r.resolved_at, r.ticks) for r in episodes(found, spine, ["cluster_id"]).collect())
    assert got == [("a", 1, 1, 2, 3, 2), ("a", 2, 5, 5, 6, 1), ("b", 1, 1, 1, 2, 1)]


def test_stretches_across_blocks_and_standing_findings_are_one_episode(spark, monkeypatch):
    from fleetscope.plans import history

    monkeypatch.setattr(history, "TICK_BLOCK", 3)
    ticks = [10, 20, 30, 41, 52, 63, 74, 85]
    spine = spark.createDataFrame([("c", t) for t in ticks], "cluster_id string, tick int")
    schema = "cluster_id string, tick int, category string, affected_entity string, title string"
    seen = {"A": [0, 1, 2, 3, 6], "B": [2, 3, 4, 5, 6, 7], "C": [0, 2, 4, 6], "S": [3]}
    found = spark.createDataFrame([("c", ticks[n], "X", "e", t) for t, places in seen.items() for n in places], schema)
    standing = spark.createDataFrame([("c", "X", "e", "S"), ("c", "X", "e", "T")], "cluster_id string, category string, affected_entity string, title string")
    got = history.episodes(found, spine, ["cluster_id"], standing=standing).collect()
    assert sorted((r.title, r.episode, r.opened, r.last_tick, r.resolved_at, r.ticks) for r in got) == [
        ("A", 1, 10, 41, 52, 4), ("A", 2, 74, 74, 85, 1), ("B", 1, 30, 85, None, 6),
        *[("C", n + 1, ticks[2 * n], ticks[2 * n], ticks[2 * n + 1], 1) for n in range(4)],
        ("S", 1, 10, 85, None, 8), ("T", 1, 10, 85, None, 8),
    ]
    assert history.episodes(found, spine, ["cluster_id"]).filter("title = 'S'").first().ticks == 1
