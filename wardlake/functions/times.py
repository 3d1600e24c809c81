"""Column helpers for dates and times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted admission time patterns; the first that fits wins.
ADMISSION_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd-MM-yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
]

# A plus anywhere, or a minus where a field begins.
SIGNED = r"\+|^-|[-/ :]-"


def _separator_at(pattern: str) -> tuple[int, str]:
    return next((i, ch) for i, ch in enumerate(pattern, 1) if ch in "-/")


def _first_parse(cell: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(cell, F.lit(p)) for p in patterns])


def parse_admission_time(cell: Column, patterns: list[str] | None = None) -> Column:
    """The timestamp by the first pattern that fits, else NULL.

    All pattern fields have a fixed width, so the length of a text and the place of
    its first separator leave one or two patterns that can fit.  Only those are
    tried.  A signed year has no fixed width: a text with a sign in front of a field
    goes through the whole list.
    """
    patterns = patterns or ADMISSION_PATTERNS
    shapes: dict[tuple[int, int, str], list[str]] = {}
    for pattern in patterns:
        shapes.setdefault((len(pattern), *_separator_at(pattern)), []).append(pattern)

    def fits(shape: tuple[int, int, str]) -> Column:
        size, place, separator = shape
        return (F.length(cell) == size) & (F.substring(cell, place, 1) == separator)

    by_shape = reduce(
        lambda chain, item: chain.when(fits(item[0]), _first_parse(cell, item[1])),
        shapes.items(),
        F.when(cell.rlike(SIGNED), _first_parse(cell, patterns)),
    )
    return by_shape


def arrival_stamp(moment: Column) -> Column:
    """ISO-8601 text with offset; the fraction is left out when it is zero."""
    return F.when(
        F.date_format(moment, "SSSSSS") == "000000",
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssxxx"),
    ).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def month_start(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "month")
