"""Closed vocabularies: error classes, event severity, score labels, severity order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope import thresholds as T

UNKNOWN = "UNKNOWN"

# Fixed values: (pattern, class) in the order they are tried, case ignored
ERROR_PATTERNS = (
    (r"OutOfMemoryError|Java heap space|java\.lang\.OutOfMemoryError", "OOM"),
    (r"GC overhead limit exceeded", "OOM"),
    (r"Container killed by YARN|Container was killed|killed by external signal", "CONTAINER_KILLED"),
    (r"beyond the .* memory limit|exceeding memory limits|Cannot allocate memory", "CONTAINER_KILLED"),
    (r"FetchFailed|FetchFailedException|shuffle fetch|Failed to connect", "SHUFFLE_FETCH"),
    (r"Connection refused|Connection reset|connection was reset", "SHUFFLE_FETCH"),
    (r"NotSerializableException|InvalidClassException|serializ", "SERIALIZATION"),
    (r"TimeoutException|ReadTimeoutException|ConnectionTimeoutException", "TIMEOUT"),
    (r"heartbeat.*timed out|Executor heartbeat timed out", "TIMEOUT"),
)
REMOVAL_PATTERNS = (
    (r"Container killed by YARN|Container was killed|killed by external signal", "CONTAINER_KILLED"),
    (r"OutOfMemory|memory limit|exceeding memory", "OOM"),
    (r"heartbeat.*timed out|lost|Executor heartbeat", "TIMEOUT"),
    (r"FetchFailed|shuffle", "SHUFFLE_FETCH"),
)

# Configuration keys that may hold secrets
SENSITIVE_KEY = r"key|secret|password|token|credential|account\.key|sas|connection\.string"

# Event type -> severity of a cluster event
EVENT_SEVERITY = {
    "SPARK_EXCEPTION": "error",
    "DRIVER_UNAVAILABLE": "error",
    "DRIVER_NOT_RESPONDING": "error",
    "NODES_LOST": "error",
    "FAILED_TO_EXPAND_DISK": "error",
    "METASTORE_DOWN": "error",
    "DBFS_DOWN": "error",
    "TERMINATING": "error",
    "TERMINATED": "error",
    "ERROR": "error",
    "UPSIZE_COMPLETED": "warning",
    "DOWNSCALED": "warning",
    "AUTOSCALING_STATS_REPORT": "warning",
    "RESTARTING": "warning",
    "INIT_SCRIPTS_FINISHED": "warning",
    "RUNNING": "normal",
    "CREATING": "normal",
    "STARTING": "normal",
    "EDITED": "normal",
}

CLUSTER_STATES = ("PENDING", "RUNNING", "RESTARTING", "RESIZING", "TERMINATING", "TERMINATED", "ERROR", UNKNOWN)
JOB_STATES = ("RUNNING", "SUCCEEDED", "FAILED", UNKNOWN)
STAGE_STATES = ("ACTIVE", "COMPLETE", "PENDING", "FAILED", "SKIPPED")
TASK_STATES = ("RUNNING", "SUCCESS", "FAILED", "KILLED", "PENDING")


def _first_match(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    (head, name), *rest = patterns
    start = F.when(text.rlike(f"(?i){head}"), name)
    return reduce(lambda acc, p: acc.when(text.rlike(f"(?i){p[0]}"), p[1]), rest, start).otherwise(UNKNOWN)


def _first_match_sql(text: str, patterns: tuple[tuple[str, str], ...]) -> str:
    doubled = [(p.replace("\\", "\\\\"), name) for p, name in patterns]
    cases = " ".join(f"when {text} rlike '(?i){p}' then '{name}'" for p, name in doubled)
    return f"case {cases} else '{UNKNOWN}' end"


def error_class_sql(text: str) -> str:
    """``classify_error`` as SQL over the column named ``text``."""
    return _first_match_sql(text, ERROR_PATTERNS)


def removal_class_sql(text: str) -> str:
    return _first_match_sql(text, REMOVAL_PATTERNS)


def classify_error(text: Column) -> Column:
    return _first_match(text, ERROR_PATTERNS)


def classify_removal(text: Column) -> Column:
    return _first_match(text, REMOVAL_PATTERNS)


def event_severity(event_type: Column) -> Column:
    """Severity of a cluster event; types outside the table are normal."""
    table = F.create_map(*[F.lit(x) for pair in EVENT_SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, event_type), F.lit("normal"))


def redact_conf(conf: Column) -> Column:
    """Configuration without the entries whose key looks sensitive."""
    return F.map_filter(conf, lambda k, v: ~k.rlike(f"(?i){SENSITIVE_KEY}"))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; 99 for anything unknown."""
    ranked = F.when(severity == T.SEVERITIES[0], 0)
    for rank, name in enumerate(T.SEVERITIES[1:], start=1):
        ranked = ranked.when(severity == name, rank)
    return ranked.otherwise(99)


def _ladder(score: Column, steps: tuple, pick: int, floor: str) -> Column:
    (head, *_), rest = steps[0], steps[1:]
    out = F.when(score >= head, steps[0][pick])
    for step in rest:
        out = out.when(score >= step[0], step[pick])
    return out.otherwise(floor)


def score_label(score: Column) -> Column:
    return _ladder(score, T.SCORE_LADDER, 1, T.SCORE_FLOOR[0])


def score_colour(score: Column) -> Column:
    return _ladder(score, T.SCORE_LADDER, 2, T.SCORE_FLOOR[1])


def component_colour(score: Column) -> Column:
    return _ladder(score, T.COMPONENT_LADDER, 1, T.COMPONENT_FLOOR)


def gc_band(gc_pct: Column) -> Column:
    return F.when(gc_pct > T.GC_BAND_HIGH_PCT, "high").when(gc_pct > T.GC_BAND_MID_PCT, "elevated").otherwise("normal")
