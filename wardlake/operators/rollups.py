"""Grouped gold tables over the enriched visits, whole or as sums that take changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.measures import visit_measures

DOCTOR_KEYS = [
    "doctor_id", "doctor_first_name", "doctor_last_name", "department", "subspecialty",
    "university", "years_of_experience",
]

# Group keys and measures of every gold table.
ROLLUPS: dict[str, tuple[list[str], list[str]]] = {
    "wait_vs_satisfaction": (
        ["wait_bucket_in_mins"],
        ["visits", "avg_satisfaction", "satisfaction_responses", "admission_rate_pct"],
    ),
    "department_monthly_stats": (
        ["department_referral", "admission_month"],
        ["visits", "avg_wait_time", "avg_satisfaction", "satisfaction_responses",
         "admission_rate_pct", "coordinator_usage_pct", "avg_age"],
    ),
    "doctor_performance": (
        DOCTOR_KEYS,
        ["visits", "avg_wait_time", "avg_satisfaction", "satisfaction_responses",
         "admission_rate_pct", "coordinator_usage_pct"],
    ),
    "coordinator_impact": (
        ["age_group", "coordinator"],
        ["visits", "avg_wait_time", "avg_satisfaction", "admission_rate_pct"],
    ),
    "wait_time_by_hour_weekday": (
        ["weekday_num", "weekday", "admission_hour"],
        ["visits", "avg_wait_time"],
    ),
}


def with_coordinator_label(visits: DataFrame) -> DataFrame:
    """Adds ``coordinator``; the flag may be an integer or a boolean, unknown counts as without."""
    involved = F.col("coordinator_involved").cast("int") == 1
    return visits.withColumn(
        "coordinator", F.when(involved, "with_coordinator").otherwise("without_coordinator")
    )


def rollup(visits: DataFrame, name: str) -> DataFrame:
    """One of ``ROLLUPS``.  NULL keys make a group of their own; averages skip NULLs.

    All measures combine on the map side, so a group that holds most of the rows
    costs one partial row per task.
    """
    keys, measures = ROLLUPS[name]
    if "coordinator" in keys:
        visits = with_coordinator_label(visits)
    columns = visit_measures()
    return visits.groupBy(*keys).agg(*[columns[m].alias(m) for m in measures])


def wait_vs_satisfaction(visits: DataFrame) -> DataFrame:
    return rollup(visits, "wait_vs_satisfaction")


def department_monthly_stats(visits: DataFrame) -> DataFrame:
    return rollup(visits, "department_monthly_stats")


def doctor_performance(visits: DataFrame) -> DataFrame:
    return rollup(visits, "doctor_performance")


def coordinator_impact(visits: DataFrame) -> DataFrame:
    return rollup(visits, "coordinator_impact")


def wait_time_by_hour_weekday(visits: DataFrame) -> DataFrame:
    return rollup(visits, "wait_time_by_hour_weekday")


# The columns that measures average, by measure: what is averaged, its digits, what it is multiplied by.
AVERAGED = {
    "avg_wait_time": ("wait_time", 1, 1),
    "avg_satisfaction": ("satisfaction_score", 2, 1),
    "admission_rate_pct": ("admission_flag", 1, 100),
    "coordinator_usage_pct": ("coordinator_involved", 1, 100),
    "avg_age": ("age", 1, 1),
}


def _averaged_columns(name: str) -> list[str]:
    needed = {AVERAGED[m][0] for m in ROLLUPS[name][1] if m in AVERAGED}
    if "satisfaction_responses" in ROLLUPS[name][1]:
        needed.add("satisfaction_score")
    return sorted(needed)


def partials(visits: DataFrame, name: str, weight: int | Column = 1) -> DataFrame:
    """A roll-up before its divisions: rows, and per averaged column the sum and the number of known values.

    All are sums, so partials of parts of the visits add up, and with ``weight`` -1 those of visits that are gone are taken away.
    """
    if "coordinator" in ROLLUPS[name][0]:
        visits = with_coordinator_label(visits)
    weight = F.lit(weight) if isinstance(weight, int) else weight
    sums = [F.sum(weight).cast("bigint").alias("visits")]
    for column in _averaged_columns(name):
        value = F.col(column).cast("bigint")
        sums.append(F.coalesce(F.sum(weight * value), F.lit(0)).cast("bigint").alias(f"sum_{column}"))
        sums.append(F.sum(weight * value.isNotNull().cast("int")).cast("bigint").alias(f"n_{column}"))
    return visits.groupBy(*ROLLUPS[name][0]).agg(*sums)


def added(some: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """The sum of two partials; groups without a visit left are gone."""
    keys = ROLLUPS[name][0]
    both = some.unionByName(more)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in keys]).where("visits <> 0")


def finished(sums: DataFrame, name: str) -> DataFrame:
    """The roll-up that partials are of."""
    keys, measures = ROLLUPS[name]

    def measure(m: str) -> Column:
        if m not in AVERAGED:
            return F.col("visits" if m == "visits" else "n_satisfaction_score")
        column, digits, times = AVERAGED[m]
        mean = F.try_divide(F.col(f"sum_{column}").cast("double"), F.col(f"n_{column}").cast("double"))
        return F.round(mean if times == 1 else F.lit(times) * mean, digits)

    return sums.select(*keys, *[measure(m).alias(m) for m in measures])
