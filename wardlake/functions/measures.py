"""Aggregate columns shared by the gold tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(column: str, digits: int) -> Column:
    return F.round(F.avg(column), digits)


def share_pct(flag: str) -> Column:
    """Share of true (or 1) among the known values, in percent."""
    return F.round(F.lit(100) * F.avg(F.col(flag).cast("int")), 1)


def visit_measures() -> dict[str, Column]:
    return {
        "visits": F.count("*"),
        "avg_wait_time": mean("wait_time", 1),
        "avg_satisfaction": mean("satisfaction_score", 2),
        "satisfaction_responses": F.count("satisfaction_score"),
        "admission_rate_pct": share_pct("admission_flag"),
        "coordinator_usage_pct": share_pct("coordinator_involved"),
        "avg_age": mean("age", 1),
    }
