"""Enrichment, roll-ups, dashboard queries and access."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardlake.operators import access, reports, rollups
from wardlake.operators.enrich import enrich_visits
from wardlake.schemas import DOCTORS, GOLD_VISITS

VISITS = (
    "visit_id STRING, admission_datetime TIMESTAMP, age INT, gender STRING, race STRING, "
    "admission_flag BOOLEAN, satisfaction_score INT, wait_time INT, department_referral STRING, "
    "coordinator_manager_flag BOOLEAN, doctor_id STRING"
)
DOCTOR = ("DOC-1", "Ann", "Lee", "Cardiology", "Heart", "U1", 12)


def visits(spark, *changes):
    base = dict(
        visit_id="v", admission_datetime=datetime(2024, 1, 14, 23, 59), age=50, gender="female",
        race="Asian", admission_flag=True, satisfaction_score=7, wait_time=20,
        department_referral="Neurology", coordinator_manager_flag=True, doctor_id="DOC-1",
    )
    rows = [tuple({**base, "visit_id": f"v{i}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, VISITS)


def doctors(spark, *rows):
    return spark.createDataFrame(list(rows), DOCTORS)


def test_enriched_columns(spark):
    row = enrich_visits(visits(spark, {}), doctors(spark, DOCTOR)).first()
    assert row.__fields__ == [c.split()[0] for c in GOLD_VISITS.split(",")]
    assert (row.admission_month, row.admission_hour) == (date(2024, 1, 1), 23)
    assert (row.weekday_num, row.weekday) == (1, "Sun")
    assert (row.age_group, row.wait_bucket_in_mins) == ("40-64", "16-30")
    assert (row.experience_bucket_in_years, row.coordinator_involved) == ("11-15", 1)
    assert (row.doctor_last_name, row.department, row.department_referral) == ("Lee", "Cardiology", "Neurology")


def test_unmatched_and_unknown(spark):
    rows = enrich_visits(
        visits(
            spark,
            {"doctor_id": "DOC-9", "department_referral": None},
            {"doctor_id": None, "admission_datetime": None, "age": None, "wait_time": None,
             "coordinator_manager_flag": None},
            {"doctor_id": "doc-1"},
        ),
        doctors(spark, DOCTOR),
    ).orderBy("visit_id").collect()
    assert [r.doctor_last_name for r in rows] == [None] * 3
    assert [r.experience_bucket_in_years for r in rows] == [None] * 3
    assert [r.department_referral for r in rows] == ["No referral", "Neurology", "Neurology"]
    blank = rows[1]
    assert (blank.admission_month, blank.admission_hour, blank.weekday, blank.age_group) == (None,) * 4
    assert (blank.wait_bucket_in_mins, blank.coordinator_involved) == (None, None)


@pytest.mark.parametrize("salts", [1, 5])
def test_one_row_per_visit_and_matching_doctor(spark, salts):
    many = visits(spark, *[{"doctor_id": d} for d in ["DOC-1"] * 40 + [None] * 20 + ["DOC-2"] * 3])
    people = doctors(spark, DOCTOR, ("DOC-2", "Bo", "Ray", "Neurology", None, None, 3),
                     ("DOC-2", "Bo", "Rey", "Neurology", None, None, 3))
    rows = enrich_visits(many, people, salts).collect()
    assert len(rows) == 40 + 20 + 3 * 2
    assert sum(r.doctor_last_name == "Lee" for r in rows) == 40
    assert sum(r.doctor_last_name is None for r in rows) == 20
    assert {r.visit_id for r in rows} == {f"v{i}" for i in range(63)}


def test_rollups(spark):
    gold = enrich_visits(
        visits(
            spark,
            {"wait_time": 10, "satisfaction_score": 8, "age": 20},
            {"wait_time": 15, "satisfaction_score": None, "admission_flag": False,
             "coordinator_manager_flag": False, "age": 21},
            {"wait_time": 50, "satisfaction_score": 3, "admission_flag": None,
             "coordinator_manager_flag": None, "age": 21},
        ),
        doctors(spark, DOCTOR),
    )
    waits = {r.wait_bucket_in_mins: r for r in rollups.wait_vs_satisfaction(gold).collect()}
    low = waits["00-15"]
    assert (low.visits, low.avg_satisfaction, low.satisfaction_responses, low.admission_rate_pct) == (2, 8.0, 1, 50.0)
    assert waits["46+"].admission_rate_pct is None
    month = rollups.department_monthly_stats(gold).first()
    assert (month.department_referral, month.admission_month) == ("Neurology", date(2024, 1, 1))
    assert (month.visits, month.avg_wait_time, month.avg_age) == (3, 25.0, 20.7)
    assert (month.avg_satisfaction, month.coordinator_usage_pct) == (5.5, 50.0)
    doctor = rollups.doctor_performance(gold).first()
    assert (doctor.doctor_id, doctor.years_of_experience, doctor.visits) == ("DOC-1", 12, 3)
    impact = {r.coordinator: r for r in rollups.coordinator_impact(gold).collect()}
    assert impact["without_coordinator"].visits == 2
    assert impact["with_coordinator"].avg_wait_time == 10.0
    hour = rollups.wait_time_by_hour_weekday(gold).first()
    assert (hour.weekday_num, hour.weekday, hour.admission_hour, hour.avg_wait_time) == (1, "Sun", 23, 25.0)


def test_coordinator_flag_may_be_boolean(spark):
    frame = spark.createDataFrame(
        [("65+", True, 10, 8, True), ("65+", None, 30, 5, False)],
        "age_group STRING, coordinator_involved BOOLEAN, wait_time INT, satisfaction_score INT, admission_flag BOOLEAN",
    )
    got = {(r.coordinator, r.visits) for r in rollups.coordinator_impact(frame).collect()}
    assert got == {("with_coordinator", 1), ("without_coordinator", 1)}


def test_rounding_is_half_up(spark):
    frame = spark.createDataFrame([("a", v) for v in (1, 1, 1, 2)] , "wait_bucket_in_mins STRING, satisfaction_score INT")
    row = rollups.wait_vs_satisfaction(frame.withColumn("admission_flag", F.lit(True))).first()
    assert row.avg_satisfaction == 1.25
    eighths = spark.createDataFrame([("a", v) for v in (1,) + (0,) * 7], "wait_bucket_in_mins STRING, satisfaction_score INT")
    row = rollups.wait_vs_satisfaction(eighths.withColumn("admission_flag", F.lit(True))).first()
    assert row.avg_satisfaction == 0.13


def test_department_totals_are_means_of_months(spark):
    monthly = spark.createDataFrame(
        [("A", date(2024, 1, 1), 100, 10.0, 4.0), ("A", date(2024, 2, 1), 1, 20.1, None), ("B", None, 2, None, None)],
        "department_referral STRING, admission_month DATE, visits BIGINT, admission_rate_pct DOUBLE, avg_satisfaction DOUBLE",
    )
    rows = {r.department_referral: r for r in reports.department_totals(monthly).collect()}
    assert (rows["A"].total_admission_rate, rows["A"].total_satisfaction) == (15.05, 4.0)
    assert (rows["B"].total_admission_rate, rows["B"].total_satisfaction) == (None, None)
    months = {r.month: r.sum_visits for r in reports.visits_per_month(monthly).collect()}
    assert months == {datetime(2024, 1, 1): 100, datetime(2024, 2, 1): 1, None: 2}


def test_department_wait_uses_the_doctors_department(spark):
    gold = enrich_visits(visits(spark, {}, {"doctor_id": None}), doctors(spark, DOCTOR))
    assert reports.department_wait(gold, ["Cardiology"]).count() == 1
    assert reports.department_wait(gold, ["Neurology"]).count() == 0


PEOPLE = [
    ("P1", "A", "Lee", "General Practice"), (None, None, None, "Cardiology"), ("P3", "C", "Ray", None),
]
PEOPLE_COLUMNS = "patient_id STRING, first_initial STRING, last_name STRING, department_referral STRING"


@pytest.mark.parametrize("groups, seen", [
    (["hospital_admin"], PEOPLE),
    (["dept_general_practice"], [("***", "***", "***", "General Practice")]),
    (["dept_cardiology", "dept_x"], [("***", "***", "***", "Cardiology")]),
    (["general_practice"], []),
    ([], []),
])
def test_secured(spark, groups, seen):
    people = spark.createDataFrame(PEOPLE, PEOPLE_COLUMNS)
    assert [tuple(r) for r in access.secured(people, groups).collect()] == seen
    reader = "of_" + "_and_".join(groups)
    access.register_access_functions(spark, groups, reader)
    people.createOrReplaceTempView("people")
    by_sql = spark.sql(
        f"SELECT {reader}_mask_pii(patient_id), {reader}_mask_pii(first_initial), {reader}_mask_pii(last_name), "
        f"department_referral FROM people WHERE {reader}_department_row_filter(department_referral)"
    )
    assert [tuple(r) for r in by_sql.collect()] == seen


def test_functions_of_a_name_keep_their_groups(spark):
    access.register_access_functions(spark, ["dept_a"], "ward")
    access.register_access_functions(spark, ["dept_a"], "ward")
    with pytest.raises(ValueError, match="ward"):
        access.register_access_functions(spark, ["dept_b"], "ward")


def test_readers_skip_the_folders_of_other_departments(spark, tmp_path, capsys):
    from wardlake.plans.lake import Lake

    lake = Lake(spark, str(tmp_path))
    gold = enrich_visits(visits(spark, {"department_referral": "Cardiology"}, {"department_referral": "Neurology"}), doctors(spark, DOCTOR))
    lake.write("visits_enriched", gold)
    laid_out = lake.read("visits_enriched", laid_out=True)
    seen = access.secured(laid_out, ["dept_cardiology"])
    assert seen.columns == gold.columns and seen.count() == 1
    for df, column in ((seen, "referral_group"), (reports.department_wait(laid_out, ["Cardiology"]), "doctor_group")):
        capsys.readouterr()
        df.explain("formatted")
        filters = next(line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line)
        assert column in filters
    assert sorted(map(tuple, lake.read("visits_enriched").collect()), key=str) == sorted(map(tuple, gold.collect()), key=str)


def test_many_readers_at_once(spark, tmp_path):
    people = spark.createDataFrame([
        ("v1", "Cardiology", "Lee"), ("v2", "General Practice", "Ray"), ("v3", None, "Fox"), ("v4", "Cardiology", None),
    ], "visit_id string, department_referral string, last_name string")
    access.with_layout(people).write.partitionBy("referral_group").parquet(f"{tmp_path}/people")
    members = [("ann", "dept_cardiology"), ("ann", "dept_cardiology"), ("ann", "dept_general_practice"), ("bob", "hospital_admin"),
               ("bob", "dept_cardiology"), ("cid", "dept_nothing"), ("dan", "clerks"), (None, "dept_cardiology"), ("eve", None)]
    spark.createDataFrame(members, "reader string, group string").write.parquet(f"{tmp_path}/members")
    stored, groups = spark.read.parquet(f"{tmp_path}/people"), spark.read.parquet(f"{tmp_path}/members")
    for table in (people, stored):
        found = sorted((tuple(r) for r in access.secured_for_members(table, groups).collect()), key=str)
        want = [
            (reader, *row) for reader in ("ann", "bob", "cid", "dan", "eve")
            for row in access.secured(people, [g for r, g in members if r == reader and g]).collect()
        ]
        assert found == sorted(want, key=str)
    plan = access.secured_for_members(stored, groups, ["ann"])
    assert "dynamicpruning" in plan._jdf.queryExecution().toString()
    assert {r.visit_id for r in plan.collect()} == {"v1", "v2", "v4"}


def test_personal_columns_are_refused(spark):
    with pytest.raises(ValueError, match="last_name"):
        access.assert_no_personal_columns(spark.createDataFrame(PEOPLE, PEOPLE_COLUMNS))
