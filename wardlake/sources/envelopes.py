"""Rows and lines -> bronze records ``(payload VARIANT, timestamp_bronze STRING)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardlake.functions.times import arrival_stamp

# Fixed value: rows sent again after a resume.
OVERLAP_ROWS = 5


def strict_json(line: Column) -> Column:
    """The line as VARIANT if it is one JSON value and nothing else, else NULL.

    Spark's parser stops after the first value, so the line is read as the only element of an
    array.  A line that closes that array itself cannot also be the value of an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    one = F.try_variant_get(listed, "$[1]", "variant").isNull() & (~F.contains(line, F.lit("]")) | named.isNotNull())
    return F.when(one, F.try_variant_get(listed, "$[0]", "variant"))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Newline-delimited JSON with a ``payload``: NULL where the line is no JSON; empty lines skipped.

    Judged as a strict decoder does: text after the value makes a bad line.  Of a repeated key the last
    value counts.  NaN and infinities are no JSON and make a bad line.
    """
    return lines.where(F.col(line) != "").withColumn("payload", strict_json(F.col(line)))


def counted(parsed: DataFrame, observation: Observation | str) -> DataFrame:
    """The same rows; ``observation`` counts read and rejected lines on the way."""
    return parsed.observe(
        observation, F.count("*").alias("lines"), F.count_if(F.col("payload").isNull()).alias("rejected")
    )


def accepted_lines(lines: DataFrame, line: str = "value", observation: Observation | str | None = None) -> DataFrame:
    """The lines that are JSON.  ``observation`` counts read and rejected lines on the way."""
    parsed = parse_lines(lines, line)
    if observation is not None:
        parsed = counted(parsed, observation)
    return parsed.where("payload IS NOT NULL")


def rejected_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that are no JSON, for a quarantine table."""
    return parse_lines(lines, line).where("payload IS NULL").drop("payload")


def to_bronze(records: DataFrame, *kept: str, arrived: Column | None = None) -> DataFrame:
    """Bronze rows of records with a ``payload``; the arrival time is now unless given."""
    moment = F.current_timestamp() if arrived is None else arrived
    return records.select("payload", arrival_stamp(moment).alias("timestamp_bronze"), *kept)
