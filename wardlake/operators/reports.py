"""Dashboard queries over the gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators.access import DEPARTMENT_GROUP, LAYOUT, of_groups

# The departments that have a chart of their own.
CHART_DEPARTMENTS = [
    "Cardiology", "Emergency Medicine", "Neurology", "Physiotherapy", "Gastroenterology",
    "General Practice", "Orthopedics",
]
# Columns of the doctors leaderboard.
LEADERBOARD = [
    "doctor_first_name", "doctor_last_name", "subspecialty", "avg_wait_time", "avg_satisfaction",
    "admission_rate_pct", "years_of_experience",
]


def _mean_of_rounded(column: str) -> Column:
    """Mean of one- and two-digit numbers to two digits, summed exactly.

    A sum of doubles depends on the order of the rows and may fall on either side
    of a half; a sum of decimals does not.
    """
    return F.round(F.avg(F.col(column).cast("decimal(20,4)")), 2).cast("double")


def department_totals(monthly: DataFrame) -> DataFrame:
    """Plain mean of the months of each department, whatever the visits in them."""
    return monthly.groupBy("department_referral").agg(
        _mean_of_rounded("admission_rate_pct").alias("total_admission_rate"),
        _mean_of_rounded("avg_satisfaction").alias("total_satisfaction"),
    )


def satisfaction_by_department(monthly: DataFrame) -> DataFrame:
    return department_totals(monthly).select("department_referral", "total_satisfaction")


def admission_rate_by_department(monthly: DataFrame) -> DataFrame:
    """Sum of the department totals; they are one row per department already, so no second group-by."""
    return department_totals(monthly).select(
        "department_referral", F.col("total_admission_rate").alias("sum_total_admission_rate")
    )


def department_wait(visits: DataFrame, departments: list[str]) -> DataFrame:
    """Wait of every visit by month, for the doctors' departments given."""
    if LAYOUT["department"] in visits.columns:
        groups = [f"{DEPARTMENT_GROUP}{d.replace(' ', '_').lower()}" for d in departments]
        visits = of_groups(visits, "department", groups)
    return visits.where(F.col("department").isin(departments)).select(
        "department", "admission_month", "wait_time"
    )


def department_wait_average(visits: DataFrame, departments: list[str]) -> DataFrame:
    return (
        department_wait(visits, departments)
        .groupBy("department", "admission_month")
        .agg(F.round(F.avg("wait_time"), 1).alias("avg_wait_time"))
    )


def visits_per_month(monthly: DataFrame) -> DataFrame:
    month = F.date_trunc("MONTH", "admission_month")
    return monthly.groupBy(month.alias("month")).agg(F.sum("visits").alias("sum_visits"))


def wait_heat_map(by_hour: DataFrame) -> DataFrame:
    return by_hour.groupBy("weekday_num", "admission_hour").agg(
        F.sum("avg_wait_time").alias("sum_avg_wait_time")
    )


def doctor_leaderboard(performance: DataFrame) -> DataFrame:
    return performance.select(*LEADERBOARD)
