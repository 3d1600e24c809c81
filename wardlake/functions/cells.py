"""Column helpers for cleaning single text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value" (exact, case-sensitive).
NULL_MARKERS = ["N/A", "Unknown", "None", "", " "]

# Accepted starts and digits of an admission flag.
YES_STARTS, YES_DIGIT = ["y", "t"], "1"
NO_STARTS, NO_DIGIT = ["n", "f"], "0"

# Starts of a gender text and the label each one gives.
GENDER_STARTS = {"m": "male", "f": "female"}


def null_if_marker(cell: Column) -> Column:
    """NULL for the marker texts, anything else as it is."""
    return F.when(~cell.isin(NULL_MARKERS), cell)


def _first_letter(cell: Column) -> Column:
    return F.lower(F.substring(cell, 1, 1))


def gender_label(cell: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for pair in GENDER_STARTS.items() for x in pair])
    return F.try_element_at(letters, _first_letter(cell))


def yes_no(cell: Column) -> Column:
    """True / false by the first letter or by a lone 1 / 0; NULL for any other text."""
    letter = _first_letter(cell)
    return (
        F.when(letter.isin(YES_STARTS) | (cell == YES_DIGIT), F.lit(True))
        .when(letter.isin(NO_STARTS) | (cell == NO_DIGIT), F.lit(False))
    )


def initial(cell: Column) -> Column:
    return F.upper(F.substring(cell, 1, 1))


def title_case(cell: Column) -> Column:
    return F.initcap(cell)


def trimmed_title(cell: Column) -> Column:
    return F.initcap(F.trim(cell))


def whole_number(cell: Column) -> Column:
    """Any decimal text cut toward zero; NULL where it is no number or does not fit."""
    return cell.try_cast("double").try_cast("int")


def text_or_na(cell: Column) -> Column:
    return F.coalesce(cell.cast("string"), F.lit("n/a"))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by a bar; NULL parts are left out."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
