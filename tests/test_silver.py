"""Bronze to silver, rules and the upsert."""

import hashlib
import json
import random
from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from wardlake.operators import quality
from wardlake.operators.doctors import clean_doctors
from wardlake.operators.patients import clean_visits
from wardlake.operators.upsert import latest_by_key, unsequenced
from wardlake.schemas import SILVER_VISITS, enforce_schema

PAYLOAD = {
    "patient_id": "P7", "patient_admission_date": "20-03-2024 07:15", "patient_first_inital": "zoe",
    "patient_last_name": "van DYK", "patient_gender": "F", "patient_age": "33.9",
    "patient_race": "Unknown", "department_referral": "general practice",
    "patient_admission_flag": "no", "patient_satisfaction_score": "9", "patient_waittime": "21",
    "patients_cm": "f", "doctor_id": "DOC-3", "file": "a.csv", "row": 4,
}
ARRIVED = "2024-03-20T08:00:00.250000+00:00"


def bronze(spark, *changes, arrived=ARRIVED):
    rows = [(json.dumps({**PAYLOAD, **c}), arrived) for c in (changes or [{}])]
    frame = spark.createDataFrame(rows, "value STRING, timestamp_bronze STRING")
    return frame.select(F.parse_json("value").alias("payload"), "timestamp_bronze")


def test_clean_visit(spark):
    row = clean_visits(bronze(spark)).first().asDict()
    key = hashlib.sha256(b"P7|2024-03-20 07:15:00").hexdigest()
    assert row.pop("silver_timestamp") is not None
    assert row == {
        "patient_id": "P7", "admission_datetime": datetime(2024, 3, 20, 7, 15), "first_initial": "Z",
        "last_name": "Van Dyk", "gender": "female", "age": 33, "race": None,
        "department_referral": "General Practice", "admission_flag": False, "satisfaction_score": 9,
        "wait_time": 21, "coordinator_manager_flag": False, "doctor_id": "DOC-3",
        "source_file": "a.csv", "source_row": 4, "visit_id": key,
        "bronze_timestamp": datetime(2024, 3, 20, 8, 0, 0, 250000),
    }


def test_declared_schema(spark):
    visits = enforce_schema(clean_visits(bronze(spark)), SILVER_VISITS)
    assert [c.split()[0] for c in SILVER_VISITS.split(",")] == visits.columns


def test_bad_values_become_null(spark):
    row = clean_visits(bronze(spark, {
        "patient_admission_date": "soon", "patient_age": "old", "patient_waittime": None,
        "patients_cm": "off", "row": "3.0", "patient_satisfaction_score": "1e99",
    })).first()
    assert (row.admission_datetime, row.age, row.wait_time) == (None, None, None)
    assert (row.coordinator_manager_flag, row.source_row, row.satisfaction_score) == (None, None, None)
    assert row.visit_id == hashlib.sha256(b"P7").hexdigest()


def test_missing_keys_and_number_cells(spark):
    frame = spark.createDataFrame([('{"patient_id": 12, "patient_age": 7.50}', "N/A")], "v STRING, t STRING")
    row = clean_visits(frame.selectExpr("parse_json(v) AS payload", "t AS timestamp_bronze")).first()
    assert (row.patient_id, row.age, row.doctor_id, row.bronze_timestamp) == ("12", 7, None, None)


def test_key_depends_on_patient_and_time_only(spark):
    rows = clean_visits(bronze(
        spark, {}, {"patient_age": "1"}, {"patient_admission_date": "2024-03-20 07:15:00"},
        {"patient_id": "P8"}, {"patient_admission_date": "2024-03-21"},
    )).collect()
    keys = {(r.patient_id, r.admission_datetime): r.visit_id for r in rows}
    assert len(keys) == len(set(keys.values())) == 3


def test_clean_doctors(spark):
    frame = spark.createDataFrame(
        [(" doc-7 ", " ann ", "LEE", " emergency medicine ", "Trauma", "U1", 3), (None,) * 6 + (None,)],
        "doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING, "
        "subspecialty STRING, university STRING, years_of_experience INT",
    )
    first, empty = clean_doctors(frame).collect()
    assert tuple(first) == ("DOC-7", "Ann", "Lee", "Emergency Medicine", "Trauma", "U1", 3)
    assert tuple(empty) == (None,) * 7


DOCTORS = [("DOC-1", "Doe", 5), ("BAD", "Doe", 5), ("DOC-2", None, 5), ("DOC-3", "Doe", -1), (None, "Doe", None)]
DOCTOR_COLUMNS = "doctor_id STRING, doctor_last_name STRING, years_of_experience INT"


def test_rules_count_drop_and_list(spark):
    doctors = spark.createDataFrame(DOCTORS, DOCTOR_COLUMNS)
    seen = Observation()
    kept = quality.expect(doctors, quality.DOCTOR_RULES, seen)
    assert [r.doctor_id for r in kept.collect()] == ["DOC-1", "BAD", "DOC-2", "DOC-3"]
    expected = {
        "existing doctor_id": 1, "doctor_id format": 2, "last name not null": 1,
        "experience non-negative": 1,
    }
    assert seen.get == {"rows": 5, **expected}
    rules = {**quality.DOCTOR_RULES.required, **quality.DOCTOR_RULES.watched}
    report = {r.rule: (r.passed, r.failed) for r in quality.rule_report(doctors, rules).collect()}
    assert report == {name: (5 - n, n) for name, n in expected.items()}
    listed = {(r.rule, r.doctor_id) for r in quality.violations(doctors, rules).collect()}
    assert listed == {
        ("existing doctor_id", None), ("doctor_id format", "BAD"), ("doctor_id format", None),
        ("last name not null", "DOC-2"), ("experience non-negative", "DOC-3"),
    }


def test_report_of_no_rows(spark):
    empty = spark.createDataFrame([], DOCTOR_COLUMNS)
    report = quality.rule_report(empty, quality.DOCTOR_RULES.watched).collect()
    assert {(r.passed, r.failed) for r in report} == {(0, 0)} and len(report) == 3


def test_watched_visits_stay(spark):
    visits = clean_visits(bronze(
        spark, {"patient_age": "130"}, {"patient_waittime": "-5"}, {"patient_id": "N/A"}
    ))
    kept = quality.keep_required(visits, quality.VISIT_RULES).collect()
    assert [(r.age, r.wait_time) for r in kept] == [(130, 21), (33, -5)]


STATE = "visit_id STRING, bronze_timestamp TIMESTAMP, source_file STRING, source_row INT, v INT"


def states(spark, rows):
    return {(r.visit_id, r.v) for r in latest_by_key(spark.createDataFrame(rows, STATE)).collect()}


def test_latest_wins_whatever_the_order(spark):
    def at(minute):
        return datetime(2024, 1, 1, 0, minute)

    rows = [
        ("a", at(1), "f", 1, 1), ("a", at(3), "f", 1, 2), ("a", at(2), "f", 9, 3),
        ("b", at(1), "f", 1, 4), ("b", at(1), "f", 2, 5), ("b", at(1), "e", 9, 6),
        ("c", None, "f", 1, 7), ("c", at(0), None, None, 8), ("d", None, "f", 1, 9),
    ]
    want = {("a", 2), ("b", 5), ("c", 8)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert states(spark, rows) == want
    nulls = unsequenced(spark.createDataFrame(rows, STATE)).collect()
    assert {r.v for r in nulls} == {7, 9}


def test_full_ties_are_decided_by_content(spark):
    moment = datetime(2024, 1, 1)
    rows = [("a", moment, "f", 1, v) for v in range(20)]
    first = states(spark, rows)
    rows.reverse()
    assert states(spark, rows) == first and len(first) == 1


def test_hot_key_is_cut_before_the_shuffle(spark):
    frame = spark.createDataFrame([("a", datetime(2024, 1, 1), "f", 1, 1)], STATE)
    plan = latest_by_key(frame)._jdf.queryExecution().executedPlan().toString()
    # A partial limit sits between the shuffle and the input.
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > plan.index("Exchange")
