"""All rules over all ticks: one pass per scope, then one union."""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscope import thresholds as T
from fleetscope.lineage import keep
from fleetscope.operators import rollups
from fleetscope.functions.parsing import parse_byte_string, text_to_double, text_to_long
from fleetscope.operators import executor_rules, stage_rules, workload_rules
from fleetscope.operators.executor_rules import EXECUTOR_RULES
from fleetscope.operators.rules import Rule, candidates, dress
from fleetscope.operators.skew import dense_number, skew_join
from fleetscope.operators.stage_rules import STAGE_RULES
from fleetscope.operators.timeline import numbered, sliding
from fleetscope.operators.workload_rules import WORKLOAD_RULES
from fleetscope.schemas import CLUSTERS, EXECUTORS, JOBS, KEY, RDDS, SQL_QUERIES, STAGES, Telemetry, conform

ALL_RULES = sorted([*EXECUTOR_RULES, *STAGE_RULES, *WORKLOAD_RULES], key=lambda r: r.ordinal)
SCHEMAS = {
    "executors": EXECUTORS, "stages": STAGES, "jobs": JOBS, "sql_queries": SQL_QUERIES, "rdds": RDDS, "clusters": CLUSTERS,
}
SCOPES = ("executor", "stage", "sql", "rdd", "key")
ROLLED_UP = ("executors", "stages")  # tables that cost a pass over all tasks
TICK_BLOCK = 4096
KEPT_WAVES = 4
POS_BLOCK = 1 << 16

# Columns of the key scope that come from a table which may be absent
ABSENT = {
    "stages": ["active_stages", "pending_stages", "failed_stages", "active_spill", "shuffle_ratio", "active_cpu_mean",
               "retried_n", "retried_warn_n", "killed_tasks", "stage_tasks"],
    "jobs": ["running_jobs", "job_failed_tasks"],
    "sql_queries": ["timed_queries", "query_seconds_mean"],
    "rdds": ["cache_n", "cache_bytes"],
}


KEY_LETS = {**executor_rules.KEY_LETS, **stage_rules.KEY_LETS, **workload_rules.KEY_LETS}


def words_of(rules: list[Rule]) -> set[str]:
    """Names used by the expressions of ``rules``, through the shared columns they refer to."""
    texts = [part for r in rules for f in r.findings() for part in (f.when, f.severity, f.metric, f.threshold, f.entity, f.pos, *f.args)]
    words: set[str] = set()
    while texts:
        new = set(re.findall(r"[A-Za-z_]\w*", texts.pop())) - words
        words |= new
        texts += [KEY_LETS[w] for w in new if w in KEY_LETS]
    return words


def with_lets(df: DataFrame, lets: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{sql} as {name}" for name, sql in lets.items()])


def read_conf(df: DataFrame) -> DataFrame:
    """Typed values of the configuration texts; text that does not parse takes the default."""
    return df.withColumns(
        {
            "advisory_bytes": parse_byte_string(F.col("advisory_text")),
            "partitions": F.coalesce(text_to_long(F.col("partitions_text")), F.lit(T.SHUFFLE_PARTITIONS_DEFAULT)),
            "memory_fraction": F.coalesce(text_to_double(F.col("memory_text")), F.lit(T.MEMORY_FRACTION_DEFAULT)),
            "storage_fraction": F.coalesce(text_to_double(F.col("storage_text")), F.lit(T.STORAGE_FRACTION_DEFAULT)),
        }
    )


class InsightPlan:
    """Scopes of a telemetry set and the rules evaluated on them.

    A report exists for every key with executor rows; findings of other keys are dropped
    by ``insights`` but kept by ``detect``. With ``store`` the executor and stage tables and the
    key facts are kept from their first use, since five branches of the plan read them; ``release``
    gives the space back. ``history`` is given when only some ticks are analysed.
    """

    def __init__(
        self, telemetry: Telemetry, rules: list[Rule] | None = None, store: bool = False, history: DataFrame | None = None
    ):
        self.rules = ALL_RULES if rules is None else rules
        self.store = store
        self.held: list[DataFrame] = []
        hold = lambda name, df: self._kept(df) if name in ROLLED_UP else df
        self.tables = telemetry.map_tables(lambda name, df: hold(name, conform(df, SCHEMAS[name])))
        # executor rows the count history looks back on, where ``telemetry`` holds only some ticks
        self.history = self.tables.executors if history is None else conform(history, EXECUTORS)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Kept facts lie in at most ``KEPT_WAVES`` parts a core: adaptive execution doesn't join small parts of a kept table, and every
        branch that reads it has a task, and a report of that task to the driver, for each of them.
        """
        if not self.store:
            return df
        session = df.sparkSession
        parts = min(KEPT_WAVES * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
        self.held.append(keep(df.repartition(parts)))
        return self.held[-1]

    def release(self) -> None:
        """Give back what the plan kept."""
        for df in self.held:
            df.unpersist()

    # -- facts per key

    @cached_property
    def executor_facts(self) -> DataFrame:
        return rollups.executor_facts(self.tables.executors)

    @cached_property
    def spine(self) -> DataFrame:
        """The reported keys."""
        return self.key_scope.select(*KEY) if self.store else self.tables.executors.select(*KEY).distinct()

    @cached_property
    def count_history(self) -> DataFrame:
        """Mean and deviation of the number of active executors over the last polls."""
        counts = self.history.groupBy(*KEY).agg(rollups.count_if(F.col("is_active")).cast("double").alias("n"))
        order = numbered(counts, ["cluster_id"], ["tick"], F.floor(F.col("tick") / TICK_BLOCK))
        frames = {"count_points": F.count("n"), "count_mean": F.avg("n"), "count_sd": F.stddev_samp("n")}
        return sliding(order, ["cluster_id"], "idx", T.RING_SIZE, frames).drop("n", "idx")

    @cached_property
    def key_scope(self) -> DataFrame:
        """One row per key: facts of every table and the configuration in force."""
        return self._kept(self._key_scope())

    def _key_scope(self, words: set[str] | None = None) -> DataFrame:
        """Key facts joined together; with ``words`` only the tables some wanted expression names a column of."""
        t = self.tables
        wanted = lambda columns: words is None or not words.isdisjoint(columns)
        out = self.executor_facts
        if wanted(["read_median", "read_factor"]):
            out = out.join(rollups.read_median(t.executors), KEY, "left")
        if wanted(["count_points"]):
            out = out.join(self.count_history, KEY, "left")
        for name, facts in (("stages", rollups.stage_facts), ("jobs", rollups.job_facts), ("sql_queries", rollups.sql_facts)):
            table = getattr(t, name)
            if not wanted(ABSENT[name]):
                continue
            if table is None:
                out = out.selectExpr("*", *[f"cast(null as double) as {c}" for c in ABSENT[name]])
            else:
                out = out.join(facts(table), KEY, "left")
        if wanted(ABSENT["rdds"]):
            if t.rdds is None:
                out = out.selectExpr("*", *[f"cast(null as bigint) as {c}" for c in ABSENT["rdds"]])
            else:
                on = [k for k in KEY if k in t.rdds.columns]
                out = out.join(rollups.rdd_facts(t.rdds, on).drop("cache_disk_bytes"), on, "left")
        if wanted(["known"]):
            conf = {"autotermination_minutes": "int", "runtime_engine": "string", "spark_conf": "map<string,string>"}
            if t.clusters is None:
                out = out.selectExpr("*", *[f"cast(null as {kind}) as {c}" for c, kind in conf.items()])
            else:
                on = [k for k in KEY if k in t.clusters.columns]
                out = out.join(t.clusters.select(*on, *conf), on, "left")
        return out

    def _key_rows(self, rules: list[Rule]) -> DataFrame:
        """The key scope with what the expressions of ``rules`` name."""
        if len(rules) == sum(r.scope == "key" for r in self.rules):
            return self.scope("key")
        words = words_of(rules)
        out = self._key_scope(words)
        if "known" in words:
            out = read_conf(with_lets(out, workload_rules.CONF_LETS))
        return with_lets(out, {n: sql for n, sql in KEY_LETS.items() if n in words})

    # -- one row per rule input

    def scope(self, name: str, words: set[str] | None = None) -> DataFrame | None:
        """Rows a rule of that scope reads, with the columns its expressions share computed once.

        With ``words``, facts of the key are attached only if an expression names them.
        """
        t = self.tables
        if name == "key":
            return with_lets(read_conf(with_lets(self.key_scope, workload_rules.CONF_LETS)), KEY_LETS)
        if name == "executor":
            return with_lets(t.executors, executor_rules.EXECUTOR_LETS)
        if name == "stage" and t.stages is not None:
            rows = t.stages
            if words is None or "cores" in words:
                facts = self.key_scope if self.store else self.executor_facts
                rows = skew_join(rows, facts.select(*KEY, "cores"), KEY)
            return with_lets(rows, stage_rules.STAGE_LETS)
        if name == "sql" and t.sql_queries is not None:
            median = rollups.sql_median(t.sql_queries).drop("query_median_ms_n")
            return with_lets(skew_join(t.sql_queries, median, KEY), workload_rules.SQL_LETS)
        if name == "rdd" and t.rdds is not None:
            return with_lets(t.rdds, workload_rules.RDD_LETS)
        return None

    def _candidates(self, scope: str, wanted) -> DataFrame | None:
        """Findings of one scope with their texts."""
        picked = lambda r: r.scope == scope and wanted(r)
        chosen = [r for r in self.rules if picked(r)]
        rows = self._key_rows(chosen) if scope == "key" else self.scope(scope, words_of(chosen))
        return None if rows is None else candidates(rows, self.rules, picked, KEY)

    def _stands(self, scope: str) -> bool:
        """Whether the scope's rows are known per cluster and hold at every tick."""
        return scope == "rdd" and self.tables.rdds is not None and "tick" not in self.tables.rdds.columns

    def _passing(self, wanted) -> DataFrame | None:
        """Findings of rows that carry a tick: union of one pass per scope that has a wanted rule."""
        scopes = [s for s in SCOPES if not self._stands(s) and any(r.scope == s and wanted(r) for r in self.rules)]
        parts = [p for p in (self._candidates(s, wanted) for s in scopes) if p is not None]
        return dress(reduce(DataFrame.unionByName, parts), self.rules) if parts else None

    def _standing(self, wanted) -> DataFrame | None:
        """Findings of datasets known per cluster, one row each: part of every report of that cluster."""
        picked = lambda r: r.scope == "rdd" and wanted(r)
        chosen = [r for r in self.rules if picked(r)]
        if not chosen or not self._stands("rdd"):
            return None
        rows = self.scope("rdd", words_of(chosen))
        return dress(candidates(rows, self.rules, picked, ["cluster_id"]), self.rules, ["cluster_id"])

    def _found(self, wanted) -> DataFrame:
        """Every wanted finding at every tick it belongs to."""
        passing, standing = self._passing(wanted), self._standing(wanted)
        if standing is None:
            return passing
        copies = skew_join(standing, self.spine, ["cluster_id"], "inner")
        return copies if passing is None else passing.unionByName(copies)

    def _reported(self, found: DataFrame) -> DataFrame:
        return found.join(self.spine, KEY, "left_semi")

    def detect(self, name: str) -> DataFrame:
        """Findings of one rule, every key."""
        return self._found(lambda r: r.name == name)

    @cached_property
    def insights(self) -> DataFrame:
        """Every finding of every reported key: one pass per scope."""
        return self._reported(self._found(lambda r: True))

    @cached_property
    def passing(self) -> DataFrame | None:
        """Findings of rows with a tick, of every reported key. With ``standing`` they say what ``insights`` says."""
        found = self._passing(lambda r: True)
        return None if found is None else self._reported(found)

    @cached_property
    def standing(self) -> DataFrame | None:
        """Findings without a tick: they hold from a cluster's first report to its last. ``None`` if no table is of that kind."""
        return self._standing(lambda r: True)

    def insights_by_rule(self) -> DataFrame:
        """The same table as one union branch per rule; kept as the reference plan in tests."""
        names = list(dict.fromkeys(r.name for r in self.rules))
        parts = [self._found(lambda r, n=n: r.name == n) for n in names]
        return self._reported(reduce(DataFrame.unionByName, parts))


def list_order() -> list:
    """Order of a report's findings within one severity: rule, worst metric where ranked, then source order."""
    return [F.col("detector").asc(), F.col("rank_metric").desc(), F.col("phase").asc(), F.col("pos").asc(), F.col("slot").asc()]


def order_struct():
    """``severity_rank`` and ``list_order`` as one comparable value, smallest first."""
    return F.struct("severity_rank", "detector", (-F.col("rank_metric")).alias("m"), "phase", "pos", "slot")


def _metric_band():
    """Monotone coarse band of ``-rank_metric``."""
    magnitude = F.floor(F.log2(1.0 + F.abs("rank_metric")) * 64)
    return F.when(F.col("rank_metric") >= 0, -magnitude).otherwise(magnitude)


def _pos_band():
    return F.when(F.col("rank_metric") == 0, F.floor(F.col("pos") / POS_BLOCK)).otherwise(0)


def with_ids(insights: DataFrame) -> DataFrame:
    """``insight_id`` = category and its counter in emission order (before the worst-first sort)."""
    order = [F.col(c).asc() for c in ("detector", "phase", "pos", "slot")]
    block = [F.col("detector"), F.col("phase"), F.floor(F.col("pos") / POS_BLOCK)]
    out = dense_number(insights, [*KEY, "category"], order, block, "seq")
    digits = F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string"))
    return out.withColumn("insight_id", F.concat_ws("_", "category", digits))


def with_rank(insights: DataFrame) -> DataFrame:
    """``place`` = position in the report: severity, then ``list_order``."""
    order = [F.col("severity_rank").asc(), *list_order()]
    # bands coarsen the order: phase and pos may only join where the metric does not rank
    block = [
        F.col("severity_rank"),
        F.col("detector"),
        _metric_band(),
        F.when(F.col("rank_metric") == 0, F.col("phase")).otherwise(0),
        _pos_band(),
    ]
    return dense_number(insights, KEY, order, block, "place")


def by_category(insights: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key and category: counts by severity, and the finding listed first."""
    worst = F.min_by(F.struct("recommendation", "severity", "advice", "affected_entity"), order_struct())
    return insights.groupBy(*key, "category").agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in T.SEVERITIES],
        worst.alias("worst"),
        F.min(order_struct()).alias("first_place"),
    )


def with_standing(categories: DataFrame | None, standing: DataFrame | None, spine: DataFrame) -> DataFrame:
    """``by_category`` of passing findings, and of standing ones, which are counted per cluster before they meet its ticks."""
    if standing is None:
        return categories
    copies = skew_join(spine, by_category(standing, ["cluster_id"]), ["cluster_id"], "inner")
    if categories is None:
        return copies
    sums = [F.sum(c).alias(c) for c in ("issues", *[s.lower() for s in T.SEVERITIES])]
    return categories.unionByName(copies).groupBy(*KEY, "category").agg(
        *sums, F.min_by("worst", "first_place").alias("worst"), F.min("first_place").alias("first_place")
    )


def as_recommendation(categories: DataFrame) -> DataFrame:
    """Title and priority of each category row."""
    name = F.initcap(F.lower(F.regexp_replace("category", "_", " ")))
    priority = F.when(F.col("critical") > 0, T.PRIORITY["CRITICAL"]).when(F.col("warning") > 0, T.PRIORITY["WARNING"])
    return categories.select(
        "*",
        F.concat(name, F.lit(": "), F.col("issues"), F.lit(" issue(s) detected")).alias("title"),
        F.col("worst.recommendation").alias("description"),
        F.col("worst.advice").alias("advice"),
        priority.otherwise(T.PRIORITY["INFO"]).alias("priority"),
    )


def recommendations(categories: DataFrame, limit: int = T.TOP_RECOMMENDATIONS) -> DataFrame:
    """The ``limit`` worst categories of a key. A key has at most as many rows as there are categories."""
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("priority", "first_place"))
    ranked = as_recommendation(categories).withColumn("place", place).filter(F.col("place") <= limit)
    return ranked.select(*KEY, "place", "category", "title", "description", "advice", "priority", "issues")
