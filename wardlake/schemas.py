"""Declared table schemas and the operator that applies one to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Column names, order and types of the tables.
BRONZE_VISITS = "payload VARIANT, timestamp_bronze STRING"

SILVER_VISITS = """
    patient_id STRING, admission_datetime TIMESTAMP, first_initial STRING, last_name STRING,
    gender STRING, age INT, race STRING, department_referral STRING, admission_flag BOOLEAN,
    satisfaction_score INT, wait_time INT, coordinator_manager_flag BOOLEAN, doctor_id STRING,
    source_file STRING, source_row INT, visit_id STRING, bronze_timestamp TIMESTAMP,
    silver_timestamp TIMESTAMP
"""

DOCTORS = """
    doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING,
    subspecialty STRING, university STRING, years_of_experience INT
"""

GOLD_VISITS = """
    visit_id STRING, admission_datetime TIMESTAMP, age INT, gender STRING, race STRING,
    admission_flag BOOLEAN, satisfaction_score INT, wait_time INT, department_referral STRING,
    coordinator_involved INT, doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING,
    department STRING, subspecialty STRING, university STRING, years_of_experience INT,
    admission_month DATE, admission_hour INT, weekday_num INT, weekday STRING, age_group STRING,
    wait_bucket_in_mins STRING, experience_bucket_in_years STRING
"""

DEPARTMENT_MONTH = """
    department_referral STRING, admission_month DATE, visits BIGINT, avg_wait_time DOUBLE,
    avg_satisfaction DOUBLE, satisfaction_responses BIGINT, admission_rate_pct DOUBLE,
    coordinator_usage_pct DOUBLE, avg_age DOUBLE
"""

INSIGHT_DOCS = """
    doc_id STRING NOT NULL, doc_type STRING, department STRING, period STRING, text STRING
"""


def enforce_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of ``ddl`` only, in that order and with those types."""
    return df.to(StructType.fromDDL(ddl))
