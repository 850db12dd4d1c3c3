"""Rules as data: a rule lists the findings it may make on one row of its scope.

Conditions, metrics and entities are SQL expressions over the scope's columns. All rules
of a scope are evaluated in one pass: a row emits an array of candidate findings holding
only what varies, those whose condition failed are dropped, and only the rest get their
fixed attributes and texts. A user adds a rule by appending a ``Rule`` to the list handed
to ``DiagnosticPlan``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fleetscope.advice import ADVICE
from fleetscope.functions.text import bytes_sql, fixed_sql, percent_sql
from fleetscope.schemas import KEY

MAX_ARGS = 4


@dataclass(frozen=True)
class Finding:
    """One possible finding.

    ``title`` and ``text`` take ``%1$s`` .. ``%4$s`` from ``args``. An argument is ``kind:expression``
    with kind ``s`` as it is, ``b`` bytes, ``p`` percent of a ratio, ``0``/``1``/``2`` fixed decimals.
    ``slot`` and ``phase`` fix its place among findings of the same row and key.
    """

    when: str
    severity: str
    category: str
    title: str
    text: str
    metric: str
    threshold: str
    advice: str
    args: tuple[str, ...] = ()
    entity: str = "''"
    slot: int = 0
    phase: int = 0
    pos: str = "pos"
    ranked: bool = False  # listed by metric, worst first
    advice_arg: int = 0  # argument appended to the advice key, 0 for none


@dataclass(frozen=True)
class Rule:
    name: str
    ordinal: int
    scope: str  # executor, stage, sql, rdd or key
    findings: Callable[[], list[Finding]]


# ---------------------------------------------------------------- SQL helpers


def num(value: float) -> str:
    """Number as SQL, floats as doubles."""
    return f"{value!r}D" if isinstance(value, float) else str(value)


def div(a: str, b: str) -> str:
    """``a / b`` as double, 0 unless ``b > 0``."""
    return f"(case when {b} > 0 then try_divide(cast({a} as double), cast({b} as double)) else 0D end)"


def steady(a: str) -> str:
    """``a`` without the noise of the last bits, so that a tie with a bound is one however rows were merged."""
    return f"round({a}, 12)"


def rung(value: str, low: float, high: float, at_low: str, at_high: str) -> str:
    return f"case when {value} >= {num(high)} then {at_high} when {value} >= {num(low)} then {at_low} end"


def grade(value: str, warn: float, crit: float) -> str:
    """CRITICAL from ``crit`` up, WARNING from ``warn`` up."""
    return rung(value, warn, crit, "'WARNING'", "'CRITICAL'")


def bound(value: str, warn: float, crit: float, scale: float = 1.0) -> str:
    """The bound ``value`` passed."""
    return rung(value, warn, crit, num(warn * scale), num(crit * scale))


def always(severity: str) -> str:
    return f"'{severity}'"


# ---------------------------------------------------------------- evaluation


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidate(code: int, f: Finding) -> str:
    args = ", ".join(f"cast({a.split(':', 1)[1]} as string)" for a in f.args)
    return (
        f"case when {f.when} then named_struct('code', {code}, 'severity', {f.severity}, 'pos', cast({f.pos} as bigint),"
        f" 'metric_value', cast({f.metric} as double), 'threshold_value', cast({f.threshold} as double),"
        f" 'affected_entity', cast({f.entity} as string), 'args', cast(array({args}) as array<string>)) end"
    )


def _fixed_part(rule: Rule, f: Finding) -> str:
    kinds = "".join(a.split(":", 1)[0] for a in f.args)
    return (
        f"named_struct('detector', {rule.ordinal}, 'rule', {_quote(rule.name)}, 'phase', {f.phase}, 'slot', {f.slot},"
        f" 'ranked', {str(f.ranked).lower()}, 'category', {_quote(f.category)}, 'title', {_quote(f.title)},"
        f" 'text', {_quote(f.text)}, 'kinds', {_quote(kinds)}, 'advice', {_quote(f.advice)}, 'advice_arg', {f.advice_arg})"
    )


def _shown() -> str:
    """Argument ``a`` number ``i`` as text, by its kind."""
    cases = {"b": bytes_sql("cast(a as double)"), "p": percent_sql("cast(a as double)")}
    cases.update({str(d): fixed_sql("a", d) for d in range(3)})
    whens = " ".join(f"when '{kind}' then {sql}" for kind, sql in cases.items())
    return f"transform(args, (a, i) -> case substring(fixed.kinds, i + 1, 1) {whens} else a end)"


def candidates(df: DataFrame, rules: list[Rule], wanted: Callable[[Rule], bool], keys: list[str]) -> DataFrame:
    """Findings that rows of ``df`` make by the ``wanted`` ones of ``rules``, without their fixed attributes."""
    numbered = enumerate((rule, f) for rule in rules for f in rule.findings())
    listed = ",\n".join(_candidate(code, f) for code, (rule, f) in numbered if wanted(rule))
    return df.selectExpr(*keys, f"inline(array({listed}))").filter("code is not null")


def dress(found: DataFrame, rules: list[Rule], keys: list[str] = KEY) -> DataFrame:
    """Add the fixed attributes and render the texts."""
    table = ", ".join(_fixed_part(rule, f) for rule in rules for f in rule.findings())
    advice = ", ".join(f"{_quote(k)}, {_quote(v)}" for k, v in ADVICE.items())
    known = found.selectExpr("*", f"element_at(array({table}), code + 1) as fixed").selectExpr("*", f"{_shown()} as shown")
    places = ", ".join(f"get(shown, {i})" for i in range(MAX_ARGS))
    return known.selectExpr(
        *keys,
        "fixed.detector", "fixed.rule", "fixed.phase", "pos", "fixed.slot",
        "case when fixed.ranked then metric_value else 0D end as rank_metric",
        "fixed.category", "severity",
        "case severity when 'CRITICAL' then 0 when 'WARNING' then 1 when 'INFO' then 2 else 99 end as severity_rank",
        f"format_string(fixed.title, {places}) as title",
        f"format_string(fixed.text, {places}) as description",
        "metric_value", "threshold_value",
        "case when fixed.advice_arg > 0 then concat(fixed.advice, element_at(args, fixed.advice_arg)) else fixed.advice end as advice",
        "affected_entity",
    ).selectExpr("*", f"try_element_at(map({advice}), advice) as recommendation")
