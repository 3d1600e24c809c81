"""Doctors as they come -> clean doctors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions.cells import trimmed_title

TITLED = ["doctor_first_name", "doctor_last_name", "department"]


def clean_doctors(raw: DataFrame) -> DataFrame:
    """Upper-case key and title-case names without outer blanks; the rest passes through.

    Keys are not made unique: a doctor given twice matches each visit twice.
    """
    return raw.withColumns({
        "doctor_id": F.upper(F.trim("doctor_id")),
        **{name: trimmed_title(F.col(name)) for name in TITLED},
    })
