"""Row rules on a stream: stateless, so a finding leaves as soon as its row arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetscope.operators import executor_rules, stage_rules, workload_rules
from fleetscope.operators.rules import Rule, candidates, dress
from fleetscope.plans.insights import ALL_RULES, SCHEMAS, with_lets, words_of
from fleetscope.schemas import KEY, conform

SCOPE_TABLES = {
    "executor": ("executors", executor_rules.EXECUTOR_LETS),
    "stage": ("stages", stage_rules.STAGE_LETS),
    "sql": ("sql_queries", workload_rules.SQL_LETS),
    "rdd": ("rdds", workload_rules.RDD_LETS),
}
# columns that come from other rows of the key; rules naming them run per tick instead
KEY_COLUMNS = {"cores", "query_median_ms", "slower"}


def row_rules(scope: str, rules: list[Rule] = ALL_RULES) -> list[Rule]:
    return [r for r in rules if r.scope == scope and words_of([r]).isdisjoint(KEY_COLUMNS)]


def row_findings(stream: DataFrame, scope: str, rules: list[Rule] = ALL_RULES) -> DataFrame:
    """Findings of the rules that need nothing but the row itself; works on batch and stream."""
    table, lets = SCOPE_TABLES[scope]
    chosen = row_rules(scope, rules)
    local = {n: sql for n, sql in lets.items() if n not in KEY_COLUMNS}
    rows = with_lets(conform(stream, SCHEMAS[table]), local)
    return dress(candidates(rows, rules, lambda r: r in chosen, KEY), rules)
