"""Gold rows as sentences: the corpus that questions are answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.cells import text_or_na

# The sentences, with {column} where a value goes.
DEPARTMENT_SENTENCE = (
    "In {admission_month}, the {department_referral} department had {visits} visits, "
    "an average wait time of {avg_wait_time} minutes, an average satisfaction score of "
    "{avg_satisfaction} ({satisfaction_responses} responses), an admission rate of "
    "{admission_rate_pct}% and coordinator usage of {coordinator_usage_pct}%. "
    "Average patient age was {avg_age}."
)
DOCTOR_SENTENCE = (
    "Dr. {doctor_first_name} {doctor_last_name} works in {department} ({subspecialty}), "
    "studied at {university} and has {years_of_experience} years of experience. "
    "Across {visits} visits: average wait time {avg_wait_time} minutes, average satisfaction "
    "{avg_satisfaction} ({satisfaction_responses} responses), admission rate "
    "{admission_rate_pct}%, coordinator usage {coordinator_usage_pct}%."
)


def sentence(template: str) -> Column:
    """The template with each ``{column}`` filled in; a NULL value reads ``n/a``."""
    pieces = []
    for chunk in template.split("{"):
        name, closed, rest = chunk.partition("}")
        pieces += [text_or_na(F.col(name)), F.lit(rest)] if closed else [F.lit(chunk)]
    return F.concat(*pieces)


def _docs(rows: DataFrame, kind: str, key: list[Column], period: Column, template: str) -> DataFrame:
    return rows.select(
        F.concat_ws("-", *key).alias("doc_id"),
        F.lit(kind).alias("doc_type"),
        F.col("department"),
        period.cast("string").alias("period"),
        sentence(template).alias("text"),
    )


def department_docs(monthly: DataFrame) -> DataFrame:
    """One sentence per department and month."""
    month = F.col("admission_month").cast("string")
    return _docs(
        monthly.withColumn("department", F.col("department_referral")),
        "department_month",
        [F.lit("dept"), F.col("department_referral"), month],
        month,
        DEPARTMENT_SENTENCE,
    )


def doctor_docs(performance: DataFrame) -> DataFrame:
    """One sentence per doctor."""
    return _docs(
        performance,
        "doctor",
        [F.lit("doctor"), F.col("doctor_id").cast("string")],
        F.lit(None),
        DOCTOR_SENTENCE,
    )


def insight_docs(monthly: DataFrame, performance: DataFrame, view: str | None = None) -> DataFrame:
    """All sentences; ``view`` also registers them as a temporary view of that name."""
    docs = department_docs(monthly).unionByName(doctor_docs(performance))
    if view:
        docs.createOrReplaceTempView(view)
    return docs
