"""Recorded runs in the store: what is written when runs stop, and comparison of stored runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.lineage import keep
from fleetscope.plans import runs
from fleetscope.plans.report import COMPONENTS, DiagnosticPlan
from fleetscope.schemas import KEY
from fleetscope.sources.run_store import RunStore

#: Tables of a whole run: itself with its configuration, the score of each report, the snapshots kept, the insights at its end
TABLES = ("runs", "run_health", "run_snapshots", "run_insights")


def record(store: RunStore, plan: DiagnosticPlan, started: DataFrame, seconds: Column, tables: tuple[str, ...] = TABLES) -> RunStore:
    """Saves runs (``runs.start_runs``) with what the reports of ``plan`` hold of them.

    ``seconds``: time of a report, by which snapshots are thinned. Findings and reports that two of the tables read are evaluated
    once and kept until the tables are written.
    """
    ticks = plan.tables.executors.select(*KEY).distinct()  # a light plan for the ticks of all reports
    of_reports = {"run_health", "run_snapshots"} & set(tables)
    shared = [plan.passing] if of_reports and "run_insights" in tables and plan.passing is not None else []
    if len(of_reports) > 1:
        shared.append(plan.report)
    for df in shared:  # findings first: a kept report reads what is kept by then
        keep(df)
    parts = {
        "runs": lambda: started.withColumn("conf", F.to_json("conf")),
        "run_health": lambda: runs.assign(plan.report.select(*KEY, "score", "executor_count", *COMPONENTS), started, ticks),
        "run_snapshots": lambda: runs.snapshots(plan.health, started, seconds, ticks=ticks),
        "run_insights": lambda: runs.export_insights(runs.stop_runs(plan.passing, ticks, started, plan.standing)),
    }
    for table in tables:
        store.save(table, parts[table]())
    for df in shared:
        df.unpersist()
    return store


@dataclass
class RunComparison:
    """Pairs of stored runs (``left_run, right_run``, in any order), the earlier start as ``a``. Reads the store, no telemetry."""

    store: RunStore
    named: DataFrame

    @cached_property
    def runs(self) -> DataFrame:
        return self.store.scan("runs").withColumn("conf", F.from_json("conf", "map<string,string>"))

    @cached_property
    def pairs(self) -> DataFrame:
        return runs.order_pairs(self.named, self.runs)

    @cached_property
    def finals(self) -> DataFrame:
        return runs.final_snapshots(self.store.scan("run_snapshots"))

    @property
    def health(self) -> DataFrame:
        """Final, average and worst score of both runs; 0 where nothing was recorded."""
        scores = self.store.scan("run_health").groupBy("run_id").agg(F.avg("score").alias("avg_score"), F.min("score").alias("worst_score"))
        stats = self.runs.select("run_id").join(scores, "run_id", "left").na.fill(0, ["avg_score", "worst_score"])
        return runs.compare_health(self.finals, stats, self.pairs)

    @property
    def insights(self) -> DataFrame:
        return runs.insight_diff(self.store.scan("run_insights"), self.pairs)

    @property
    def components(self) -> DataFrame:
        return runs.component_diff(self.finals, self.pairs)

    @property
    def conf(self) -> DataFrame:
        return runs.conf_diff(self.runs, self.pairs)
