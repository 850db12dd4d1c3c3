"""Importing this module registers every query."""

from fleetscope.catalog import history_queries, ingest_queries, insight_queries, report_queries  # noqa: F401
from fleetscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
