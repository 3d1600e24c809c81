"""Data-quality rules: drop, warn, report, list the violating rows.

A rule is a SQL condition.  A row passes when the condition is true; false and
NULL both count as failed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RuleSet:
    """``required`` rules drop the rows that fail; ``watched`` rules only count them."""

    required: dict[str, str] = field(default_factory=dict)
    watched: dict[str, str] = field(default_factory=dict)


# Rule names and conditions.
VISIT_RULES = RuleSet(
    required={"existing patient_id": "patient_id IS NOT NULL"},
    watched={
        "age check": "age IS NULL OR (age >= 0 AND age < 120)",
        "satisfaction score check": "satisfaction_score IS NULL OR (satisfaction_score BETWEEN 0 AND 10)",
        "wait time check": "wait_time IS NULL OR wait_time >= 0",
        "doctor id exists": "doctor_id IS NOT NULL",
    },
)
DOCTOR_RULES = RuleSet(
    required={"existing doctor_id": "doctor_id IS NOT NULL"},
    watched={
        "doctor_id format": "doctor_id RLIKE '^DOC-[0-9]+$'",
        "last name not null": "doctor_last_name IS NOT NULL",
        "experience non-negative": "years_of_experience IS NULL OR years_of_experience >= 0",
    },
)


def _passes(rule: str) -> Column:
    return F.coalesce(F.expr(rule), F.lit(False))


def keep_required(df: DataFrame, rules: RuleSet) -> DataFrame:
    """The rows that pass every required rule."""
    for rule in rules.required.values():
        df = df.where(F.expr(rule))
    return df


def observe_rules(df: DataFrame, rules: RuleSet, observation: Observation | str) -> DataFrame:
    """Count rows and failures of every rule while the rows flow by (no extra job).

    With a name instead of an ``Observation`` it works on streams: the counts are
    in each batch's progress.
    """
    every = {**rules.required, **rules.watched}
    return df.observe(
        observation,
        F.count("*").alias("rows"),
        *[F.count_if(~_passes(rule)).alias(name) for name, rule in every.items()],
    )


def expect(df: DataFrame, rules: RuleSet, observation: Observation | str | None = None) -> DataFrame:
    """Count failures, then drop the rows that fail a required rule.

    Watched rules are counted on all incoming rows, the dropped ones included.
    """
    if observation is not None:
        df = observe_rules(df, rules, observation)
    return keep_required(df, rules)


def rule_report(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rule, passed, failed`` for every rule, from one pass over the rows."""
    counts = df.agg(
        F.array(*[
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(_passes(rule)).alias("passed"),
                F.count_if(~_passes(rule)).alias("failed"),
            )
            for name, rule in rules.items()
        ]).alias("rules")
    )
    return counts.select(F.inline("rules"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Every row once per rule it fails, with the rule's name; one pass."""
    failed = F.array(*[F.when(~_passes(rule), F.lit(name)) for name, rule in rules.items()])
    return df.select(F.explode(F.array_compact(failed)).alias("rule"), "*")
