"""Workload-telemetry analytics for a fleet of Spark clusters, as DataFrame jobs."""

from fleetscope.plans.report import DiagnosticPlan
from fleetscope.schemas import KEY, Telemetry

__all__ = ["KEY", "DiagnosticPlan", "Telemetry"]
