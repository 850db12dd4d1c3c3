"""Health score and the diagnostic report per key."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.functions.classify import score_colour, score_label
from fleetscope.functions.numbers import clamp100, ratio, whole
from fleetscope.plans.insights import InsightPlan, as_recommendation, by_category, recommendations, with_standing
from fleetscope.schemas import KEY

COMPONENTS = list(T.HEALTH_WEIGHTS)
SPILL_FULL_BYTES = 10 * T.GIB


def summary(categories: DataFrame) -> DataFrame:
    """One row per key: finding counts, points lost per penalised component, leading recommendation."""
    points = F.col("critical") * T.PENALTY_CRITICAL + F.col("warning") * T.PENALTY_WARNING
    lead = F.min_by(F.struct("title", "priority"), F.struct("priority", "first_place"))
    return as_recommendation(categories).groupBy(*KEY).agg(
        F.sum("issues").alias("insights"),
        *[F.sum(s.lower()).alias(s.lower()) for s in T.SEVERITIES],
        *[
            F.sum(F.when(F.col("category").isin(*group), points).otherwise(0)).alias(f"lost_{name}")
            for name, group in T.PENALTY_CATEGORIES.items()
        ],
        lead.alias("lead"),
    )


def component_columns() -> dict:
    """The ten components over a row with key facts and penalties; null where no executor is active."""
    has_workers = F.col("worker_n") > 0
    gc = F.when(has_workers, F.col("worker_gc_max")).otherwise(F.col("active_gc_max")) * 100.0
    reads = F.when(has_workers, F.col("read_n")).otherwise(F.col("active_read_n"))
    read_mean = F.when(has_workers, F.col("worker_read_mean")).otherwise(F.col("active_read_mean"))
    read_sd = F.when(has_workers, F.col("worker_read_sd")).otherwise(F.col("active_read_sd"))
    used = ratio(F.col("active_tasks"), F.col("slots")) * 100.0
    finished = F.col("completed_tasks") + F.col("failed_tasks")
    failed = ratio(F.col("failed_tasks"), finished) * 100.0

    def bounded(defined, value):
        return F.when(defined, clamp100(whole(value))).otherwise(100)

    out = {
        "gc": bounded(gc.isNotNull(), 100 - (gc - 2) * (100 / 18)),
        "spill": bounded(F.col("active_stages") > 0, 100 - F.col("active_spill") / SPILL_FULL_BYTES * 100),
        "skew": bounded((reads >= 2) & (read_mean > 0), 100 - (F.try_divide(read_sd, read_mean) - 0.3) * (100 / 1.7)),
        "utilization": F.when(F.col("slots") > 0, F.least(F.lit(100), whole(used * (100 / 80)))).otherwise(100),
        "shuffle": bounded(F.col("shuffle_ratio").isNotNull(), 100 - (F.col("shuffle_ratio") - 0.5) * (100 / 4.5)),
        "task_failures": bounded(finished > 0, 100 - failed / 5 * 100),
    }
    for name in T.PENALTY_CATEGORIES:
        out[name] = F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.col(f"lost_{name}"), F.lit(0)))
    return {name: F.when(F.col("active_n") > 0, out[name].cast("int")) for name in COMPONENTS}


class DiagnosticPlan(InsightPlan):
    """Insights plus score, recommendations and the report."""

    @cached_property
    def categories(self) -> DataFrame:
        passing = None if self.passing is None else by_category(self.passing)
        return with_standing(passing, self.standing, self.spine)

    @cached_property
    def facts(self) -> DataFrame:
        """Key facts and the summary of the key's findings."""
        return self.key_scope.join(summary(self.categories), KEY, "left")

    @cached_property
    def health_components(self) -> DataFrame:
        kept = ["active_n", "active_stages", "running_jobs", "insights", *[s.lower() for s in T.SEVERITIES], "lead"]
        return self.facts.select(*KEY, *kept, *[c.alias(n) for n, c in component_columns().items()])

    @cached_property
    def report(self) -> DataFrame:
        """One row per key: score, label, components, entity and finding counts, leading recommendation.

        A key without active executors scores 0 / ``N/A`` and has no components.
        """
        total = None
        for name, weight in T.HEALTH_WEIGHTS.items():
            part = F.col(name).cast("double") * F.lit(weight)
            total = part if total is None else total + part
        live = F.col("active_n") > 0
        scored = self.health_components.withColumn("score", F.when(live, clamp100(whole(total))).otherwise(0).cast("int"))
        return scored.select(
            *KEY,
            "score",
            F.when(live, score_label(F.col("score"))).otherwise("N/A").alias("label"),
            F.when(live, score_colour(F.col("score"))).otherwise("dim").alias("color"),
            *COMPONENTS,
            F.col("active_n").alias("executor_count"),
            *[
                F.coalesce(source, F.lit(0)).cast("long").alias(name)
                for source, name in (
                    ("active_stages", "active_stage_count"), ("running_jobs", "active_job_count"), ("insights", "insights"),
                    ("critical", "critical"), ("warning", "warning"), ("info", "info"),
                )
            ],
            F.col("lead.title").alias("top_title"),
            F.col("lead.priority").alias("top_priority"),
        )

    @cached_property
    def health(self) -> DataFrame:
        return self.report.select(*KEY, "score", "label", "color", *COMPONENTS)

    @cached_property
    def recommendations(self) -> DataFrame:
        return recommendations(self.categories)
