"""The 26 rules, their union, order, ids, score, recommendations and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.catalog.oracle_base import CTES, DETECTORS
from fleetscope.catalog.registry import query, r6
from fleetscope.plans.alignment import align
from fleetscope.plans.insights import with_ids, with_rank
from fleetscope.plans.report import COMPONENTS, DiagnosticPlan
from fleetscope.schemas import KEY

FINDING = ["category", "severity", "affected_entity", "title"]
FINDING_SQL = (
    "cluster_id, tick, category, severity, affected_entity, title,"
    " round(metric_value,6) metric_value, round(threshold_value,6) threshold_value"
)


def finding_columns() -> list:
    return [*KEY, *FINDING, r6("metric_value"), r6("threshold_value")]


def _register(name: str) -> None:
    @query(name, f"select {FINDING_SQL} from d_{name}")
    def detector(v):
        return DiagnosticPlan(v.telemetry).detect(name).select(*finding_columns())


for _detector in DETECTORS:
    _register(_detector)


@query("insight_union", f"select det detector, slot, {FINDING_SQL} from i_all")
def insight_union(v):
    return DiagnosticPlan(v.telemetry, store=True).insights.select("detector", "slot", *finding_columns())


@query(
    "insight_rank",
    "select cluster_id, tick, category, severity, affected_entity, title,"
    " row_number() over (partition by cluster_id, tick order by sev, det, rank_metric desc, phase, pos, slot) place from i_all",
)
def insight_rank(v):
    return with_rank(DiagnosticPlan(v.telemetry, store=True).insights).select(*KEY, *FINDING, "place")


@query(
    "insight_sequence",
    "select cluster_id, tick, category, affected_entity, title, concat(category, '_', case when n<1000 then lpad(cast(n as varchar),3,'0') else cast(n as varchar) end) insight_id"
    " from (select *, row_number() over (partition by cluster_id, tick, category order by det, phase, pos, slot) n from i_all) x",
)
def insight_sequence(v):
    return with_ids(DiagnosticPlan(v.telemetry, store=True).insights).select(*KEY, "category", "affected_entity", "title", "insight_id")


_COMPONENTS_SQL = ", ".join(
    f"cast(case when active_n>0 then {c} end as int) {c}"
    for c in COMPONENTS
)


@query("health_components", f"select cluster_id, tick, {_COMPONENTS_SQL} from h_comp")
def health_components(v):
    return DiagnosticPlan(v.telemetry, store=True).health_components.select(*KEY, *COMPONENTS)


@query("health_score", f"select cluster_id, tick, score, label, color, {_COMPONENTS_SQL} from h_label")
def health_score(v):
    return DiagnosticPlan(v.telemetry, store=True).health


@query("recommendations", "select cluster_id, tick, place, category, title, description, advice, priority, issues from h_rec")
def all_recommendations(v):
    p = DiagnosticPlan(v.telemetry, store=True)
    from fleetscope.plans.insights import recommendations

    return recommendations(p.categories, limit=len(DETECTORS))


@query(
    "top_recommendations",
    "select cluster_id, tick, place, category, title, description, advice, priority, issues from h_rec where place<=5",
)
def top_recommendations(v):
    return DiagnosticPlan(v.telemetry, store=True).recommendations


_REPORT_SQL = (
    f"select h.cluster_id, h.tick, score, label, color, {_COMPONENTS_SQL}, active_n executor_count, active_stage_count, active_job_count,"
    " insights, critical, warning, info, r.title top_title, r.priority top_priority"
    " from h_label h left join h_rec r on h.cluster_id=r.cluster_id and h.tick=r.tick and r.place=1"
)


@query("diagnostic_report", _REPORT_SQL)
def diagnostic_report(v):
    return DiagnosticPlan(v.telemetry, store=True).report


@query(
    "active_entities",
    "select e.cluster_id, e.tick, active_n executor_count, coalesce(active_stages,0) active_stage_count, coalesce(running,0) active_job_count"
    " from k_exec e left join k_stage s on e.cluster_id=s.cluster_id and e.tick=s.tick left join k_job j on e.cluster_id=j.cluster_id and e.tick=j.tick",
)
def active_entities(v):
    from fleetscope.operators import rollups

    executors = rollups.executor_facts(v.executors).select(*KEY, F.col("active_n").alias("executor_count"))
    stages = rollups.stage_facts(v.stages).select(*KEY, F.col("active_stages").alias("active_stage_count"))
    jobs = rollups.job_facts(v.jobs.withColumnRenamed("num_failed", "num_failed_tasks")).select(
        *KEY, F.col("running_jobs").alias("active_job_count")
    )
    return executors.join(stages, KEY, "left").join(jobs, KEY, "left").na.fill(0, ["active_stage_count", "active_job_count"])


# SQL is polled at the first and third quarter only, and the third fails in odd years: reports keep the last good poll
_ALIGNED = {
    "tv_sqls_all": CTES["tv_sqls"],
    "k_good": "select distinct cluster_id, tick from tv_execs where tick%10=1 or tick%10=3 and (tick//10)%2=0",
    "k_source": "select s.cluster_id, s.tick, max(g.tick) source from k_spine s join k_good g on s.cluster_id=g.cluster_id and g.tick<=s.tick group by s.cluster_id, s.tick",
    "tv_sqls": "select a.* replace (k.tick as tick) from tv_sqls_all a join k_source k on a.cluster_id=k.cluster_id and a.tick=k.source",
}


def sql_polls(v):
    ticks = v.executors.select(*KEY).distinct().filter("tick % 10 in (1, 3)")
    return ticks.withColumn("ok", F.expr("tick % 10 = 1 or floor(tick / 10) % 2 = 0"))


@query("aligned_report", _REPORT_SQL, _ALIGNED)
def aligned_report(v):
    return DiagnosticPlan(align(v.telemetry, {"sql_queries": sql_polls(v)}), store=True).report


@query("aligned_sql_anomalies", f"select {FINDING_SQL} from d_sql_anomalies", _ALIGNED)
def aligned_sql_anomalies(v):
    return DiagnosticPlan(align(v.telemetry, {"sql_queries": sql_polls(v)})).detect("sql_anomalies").select(*finding_columns())
