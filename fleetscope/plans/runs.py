"""Recorded runs: which reports belong to a run, what is kept of them, and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions.classify import redact_conf
from fleetscope.lineage import keep
from fleetscope.operators.intervals import inside
from fleetscope.operators.skew import dense_number, skew_join
from fleetscope.operators.throttle import throttle
from fleetscope.plans.history import TITLE_KEY, accumulate
from fleetscope.plans.report import COMPONENTS

RUN = ["cluster_id", "run_id"]
UNSET = "(unset)"
ABSENT_COMPONENT = 100


def start_runs(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Run rows with the redacted configuration of their cluster at the start.

    ``requests``: ``cluster_id, run_id, name, start_tick, stop_tick`` (stop null while recording).
    """
    conf = clusters.select("cluster_id", redact_conf(F.col("spark_conf")).alias("conf"))
    return requests.join(conf, "cluster_id", "left").withColumn("conf", F.coalesce("conf", F.create_map().cast("map<string,string>")))


def assign(reports: DataFrame, runs: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Rows of ``reports`` (any table with ``cluster_id, tick``) that fall into a run of their cluster.

    The join reads the ticks more than once: those of ``ticks`` (``cluster_id, tick`` of all reports) where given, else of the
    reports themselves, which are kept for that.
    """
    windows = runs.select(*RUN, "start_tick", "stop_tick")
    held = lambda rows: inside(rows, windows, ["cluster_id"], "tick", "start_tick", "stop_tick").drop("start_tick", "stop_tick")
    if ticks is None:
        return held(keep(reports))
    return skew_join(reports, held(keep(ticks.select("cluster_id", "tick").distinct())), ["cluster_id", "tick"], "inner")


def stop_runs(insights: DataFrame, report_ticks: DataFrame, runs: DataFrame, standing: DataFrame | None = None) -> DataFrame:
    """Accumulated insights of every run, as exported when it stops.

    ``standing`` findings have no tick and belong to every report of their cluster; they meet the runs as one row each.
    """
    ticks = keep(report_ticks.select("cluster_id", "tick").distinct())
    spine = keep(assign(ticks, runs))
    return accumulate(skew_join(insights, spine, ["cluster_id", "tick"], "inner"), spine, RUN, standing=standing)


def snapshots(health: DataFrame, runs: DataFrame, seconds: Column, gap: int = T.SNAPSHOT_GAP_S, ticks: DataFrame | None = None) -> DataFrame:
    """Reports of a run kept at least ``gap`` seconds apart."""
    timed = keep(assign(health, runs, ticks).withColumn("at_s", seconds))
    return timed.join(throttle(timed, RUN, "at_s", gap), [*RUN, "at_s"], "left_semi")


def run_stats(health: DataFrame, accumulated: DataFrame, runs: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Average and worst score and insight count per run; 0 where nothing was recorded."""
    scores = assign(health, runs, ticks).groupBy(*RUN).agg(
        F.avg("score").alias("avg_score"), F.min("score").alias("worst_score"), F.count(F.lit(1)).alias("cycles")
    )
    found = accumulated.groupBy(*RUN).agg(F.count(F.lit(1)).alias("insights"))
    out = runs.select(*RUN, "name", "start_tick", "stop_tick").join(scores, RUN, "left").join(found, RUN, "left")
    return out.na.fill(0, ["avg_score", "worst_score", "cycles", "insights"])


def export_insights(accumulated: DataFrame) -> DataFrame:
    """Columns of a saved insight."""
    return accumulated.select(
        *RUN, "category", "severity", "peak_severity", "peak_rank", "title", "description", "recommendation", "affected_entity", "first_seen",
        "last_seen", "resolved_at", "occurrence_count", "peak_metric_value", "metric_value", "threshold_value",
    )


# ---------------------------------------------------------------- comparison


def order_pairs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``left_run, right_run`` -> ``run_a`` (earlier start) and ``run_b``."""
    starts = runs.select("run_id", "start_tick")
    left = starts.toDF("left_run", "left_start")
    right = starts.toDF("right_run", "right_start")
    both = pairs.join(left, "left_run").join(right, "right_run")
    swap = F.col("left_start") > F.col("right_start")
    return both.select(
        F.when(swap, F.col("right_run")).otherwise(F.col("left_run")).alias("run_a"),
        F.when(swap, F.col("left_run")).otherwise(F.col("right_run")).alias("run_b"),
    )


def _sides(df: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both runs of each pair, matched on ``key``: structs ``a`` and ``b``, null where absent."""
    rows = [c for c in df.columns if c not in ("run_id", *key)]
    sides = {}
    for side in ("a", "b"):
        held = df.select(F.col("run_id").alias(f"run_{side}"), *key, F.struct(F.lit(True).alias("present"), *rows).alias(side))
        sides[side] = pairs.join(held, f"run_{side}")
    return sides["a"].join(sides["b"], ["run_a", "run_b", *key], "full")


def insight_diff(exported: DataFrame, pairs: DataFrame) -> DataFrame:
    """``resolved`` (only in a), ``new`` (only in b) or ``persistent`` with the change of the metric."""
    kept = exported.select("run_id", *TITLE_KEY, "severity", "peak_severity", "metric_value", "first_seen", "peak_rank")
    both = _sides(kept, pairs, TITLE_KEY)
    change = F.when(F.col("b").isNull(), "resolved").when(F.col("a").isNull(), "new").otherwise("persistent")
    return both.select(
        "run_a", "run_b", *TITLE_KEY, change.alias("change"),
        F.coalesce("b.severity", "a.severity").alias("severity"), F.coalesce("b.peak_severity", "a.peak_severity").alias("peak_severity"),
        (F.col("b.metric_value") - F.col("a.metric_value")).alias("metric_delta"),
        F.coalesce("a.peak_rank", "b.peak_rank").alias("peak_rank"), F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"),
    )


def component_diff(finals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Component scores of the final snapshots; a missing score counts as 100."""
    long = finals.unpivot(["run_id"], COMPONENTS, "component", "score").filter(F.col("score").isNotNull())
    both = _sides(long, pairs, ["component"])
    a, b = (F.coalesce(f"{s}.score", F.lit(ABSENT_COMPONENT)) for s in ("a", "b"))
    return both.select("run_a", "run_b", "component", a.alias("score_a"), b.alias("score_b"), (b - a).alias("delta"))


def conf_diff(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Configuration keys whose values differ; absent values show as ``(unset)``."""
    entries = runs.select("run_id", F.explode("conf").alias("conf_key", "conf_value"))
    both = _sides(entries, pairs, ["conf_key"])
    a, b = (F.coalesce(f"{s}.conf_value", F.lit(UNSET)) for s in ("a", "b"))
    return both.select("run_a", "run_b", "conf_key", a.alias("value_a"), b.alias("value_b")).filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def final_snapshots(kept: DataFrame) -> DataFrame:
    """Last kept snapshot of each run."""
    row = F.max_by(F.struct("score", *COMPONENTS), F.col("tick"))
    return kept.groupBy("run_id").agg(row.alias("f")).select("run_id", "f.*")


def compare_health(finals: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Final, average and worst score of both runs; a run without snapshots counts as 0."""
    facts = stats.select("run_id", "avg_score", "worst_score").join(finals.select("run_id", "score"), "run_id", "left").na.fill(0, ["score"])
    out = pairs
    for side in ("a", "b"):
        out = out.join(facts.toDF(f"run_{side}", f"avg_score_{side}", f"worst_score_{side}", f"health_{side}"), f"run_{side}")
    return out.withColumn("health_delta", F.col("health_b") - F.col("health_a"))


def limit_diff(diff: DataFrame, limit: int = T.DIFF_INSIGHTS) -> DataFrame:
    """The first ``limit`` insights of each change class, with the number left out."""
    group = ["run_a", "run_b", "change"]
    order = [F.col("peak_rank").asc(), F.col("first_seen").asc(), *[F.col(c).asc() for c in TITLE_KEY]]
    diff = keep(diff)
    numbered = dense_number(diff, group, order, None, "place")
    totals = diff.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    listed = numbered.filter(F.col("place") <= limit).join(totals, group)
    return listed.withColumn("more", F.greatest(F.lit(0), F.col("total") - limit)).drop("total")


def limit_conf(diff: DataFrame, limit: int = T.DIFF_CONF) -> DataFrame:
    """The first ``limit`` changed keys of each pair; a configuration has few keys."""
    numbered = dense_number(diff, ["run_a", "run_b"], [F.col("conf_key").asc()], [F.substring("conf_key", 1, 8)], "place")
    return numbered.filter(F.col("place") <= limit)
