"""Incremental reports: each trigger recomputes the ticks that received rows, late ones included."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscope import thresholds as T
from fleetscope.operators import timeline
from fleetscope.operators.series import tick_block
from fleetscope.plans.insights import SCHEMAS
from fleetscope.plans.report import DiagnosticPlan
from fleetscope.schemas import Telemetry

TICKED = ("executors", "stages", "jobs", "sql_queries")


@dataclass(frozen=True)
class ReportStream:
    """Landing tables ``<inbox>/<table>`` (parquet with the contract's columns) -> ``<out>/report`` by tick.

    A trigger finds the ticks touched by new rows of any table, adds the polls whose history
    window reaches back to them, recomputes exactly those ticks from the landed tables and
    replaces their partitions. Replaying a batch gives the same partitions, and rows arriving
    late or out of order lead to the same result as one batch over everything.
    """

    spark: SparkSession
    inbox: str
    out: str

    def schema(self, table: str) -> str:
        body = ", ".join(f"{n} {k}" for n, k in SCHEMAS[table].items())
        return f"cluster_id string, tick int, pos bigint, {body}"

    def landed(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.schema(table)).parquet(f"{self.inbox}/{table}")

    def _stream(self, table: str) -> DataFrame:
        return self.spark.readStream.schema(self.schema(table)).parquet(f"{self.inbox}/{table}").select("cluster_id", "tick")

    def affected(self, touched: DataFrame) -> DataFrame:
        """Ticks to recompute: those touched, and those of a cluster whose history window holds a touched one."""
        polls = timeline.numbered(self.landed("executors").select("cluster_id", "tick").distinct(), ["cluster_id"], ["tick"], tick_block())
        hit = polls.join(touched.distinct(), ["cluster_id", "tick"], "left_semi")
        reach = hit.select("cluster_id", F.explode(F.sequence(F.col("idx"), F.col("idx") + T.RING_SIZE - 1)).alias("idx")).distinct()
        return polls.join(reach, ["cluster_id", "idx"], "left_semi").select("tick").union(touched.select("tick")).distinct()

    def recompute(self, touched: DataFrame, _batch_id: int) -> None:
        ticks = self.affected(touched)
        part = {t: self.landed(t).join(ticks, "tick", "left_semi") for t in TICKED}
        fixed = {t: self.spark.read.parquet(f"{self.inbox}/{t}") for t in ("rdds", "clusters")}
        report = DiagnosticPlan(Telemetry(**part, **fixed), history=self.landed("executors")).report
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tick").parquet(f"{self.out}/report")

    def start(self, checkpoint: str) -> StreamingQuery:
        touched = reduce(DataFrame.union, [self._stream(t) for t in TICKED])
        return (
            touched.writeStream.foreachBatch(self.recompute)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def report(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/report")
