"""Bronze payload -> clean visit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import cells
from wardlake.functions.times import parse_admission_time

# Payload key -> visit column.  The misspelt key is how the data comes.
PAYLOAD_KEYS = {
    "patient_id": "patient_id",
    "patient_admission_date": "admission_datetime",
    "patient_first_inital": "first_initial",
    "patient_last_name": "last_name",
    "patient_gender": "gender",
    "patient_age": "age",
    "patient_race": "race",
    "department_referral": "department_referral",
    "patient_admission_flag": "admission_flag",
    "patient_satisfaction_score": "satisfaction_score",
    "patient_waittime": "wait_time",
    "patients_cm": "coordinator_manager_flag",
    "doctor_id": "doctor_id",
    "file": "source_file",
    "row": "source_row",
}

# How the text of each column becomes its value; columns not named stay text.
CLEANERS = {
    "admission_datetime": parse_admission_time,
    "first_initial": cells.initial,
    "last_name": cells.title_case,
    "gender": cells.gender_label,
    "age": cells.whole_number,
    "race": cells.title_case,
    "department_referral": cells.title_case,
    "admission_flag": cells.yes_no,
    "satisfaction_score": cells.whole_number,
    "wait_time": cells.whole_number,
    "coordinator_manager_flag": lambda c: c.try_cast("boolean"),
    "source_row": lambda c: c.try_cast("int"),
}


def payload_texts(bronze: DataFrame, *keep: str) -> DataFrame:
    """One text column per known payload key, plus the columns in ``keep``.

    A missing key and a JSON null give NULL.  On a parquet bronze table the scan
    reads only these fields of the payload.
    """
    fields = [
        F.try_variant_get("payload", f'$["{key}"]', "string").alias(name)
        for key, name in PAYLOAD_KEYS.items()
    ]
    return bronze.select(*fields, "timestamp_bronze", *keep)


def drop_markers(texts: DataFrame, *keep: str) -> DataFrame:
    """NULL for every marker text, in all string columns but those in ``keep``."""
    return texts.select(*[
        cells.null_if_marker(F.col(name)).alias(name)
        if kind == "string" and name not in keep else F.col(name)
        for name, kind in texts.dtypes
    ])


def _value(name: str) -> Column:
    return CLEANERS[name](F.col(name)).alias(name) if name in CLEANERS else F.col(name)


def clean_visits(bronze: DataFrame, *keep: str, stamp: bool = True) -> DataFrame:
    """The clean visit table of a bronze DataFrame (batch or stream).

    ``stamp=False`` leaves out the processing time, the one column that differs
    between two runs over the same input.
    """
    texts = drop_markers(payload_texts(bronze, *keep), *keep)
    typed = texts.select(
        *[_value(name) for name in PAYLOAD_KEYS.values()], "timestamp_bronze", *keep
    )
    visits = typed.select(
        *PAYLOAD_KEYS.values(),
        cells.content_key(F.col("patient_id"), F.col("admission_datetime")).alias("visit_id"),
        F.try_to_timestamp("timestamp_bronze").alias("bronze_timestamp"),
        *keep,
    )
    return visits.withColumn("silver_timestamp", F.current_timestamp()) if stamp else visits
