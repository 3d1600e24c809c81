"""Visits joined to doctors, with calendar columns and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions.bands import AGE_BANDS, EXPERIENCE_BANDS, WAIT_BANDS, band
from wardlake.functions.times import month_start
from wardlake.schemas import GOLD_VISITS, enforce_schema

NO_REFERRAL = "No referral"

FROM_VISIT = [
    "visit_id", "admission_datetime", "age", "gender", "race", "admission_flag",
    "satisfaction_score", "wait_time", "department_referral", "coordinator_manager_flag", "doctor_id",
]
FROM_DOCTOR = [
    "doctor_id", "doctor_first_name", "doctor_last_name", "department", "subspecialty",
    "university", "years_of_experience",
]


def join_doctors(visits: DataFrame, doctors: DataFrame, salts: int = 1) -> DataFrame:
    """Left join on the doctor key; visits without a match keep NULL doctor columns.

    There is no hint: Spark broadcasts the doctors when their size is under the
    session's threshold and otherwise sorts both sides, splitting hot doctors at
    run time.  ``salts > 1`` spreads every doctor over that many partitions for
    a sorted join with keys too hot for that; visits without a key never match
    and are spread too.
    """
    if salts <= 1:
        return visits.join(doctors, "doctor_id", "left")
    salted_visits = visits.withColumn("_salt", F.pmod(F.xxhash64("visit_id"), F.lit(salts)).cast("int"))
    salted_doctors = doctors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    unknown = F.concat(F.lit("\u0000"), F.col("visit_id"))
    return (
        salted_visits.withColumn("_match", F.coalesce("doctor_id", unknown))
        .join(salted_doctors.withColumnRenamed("doctor_id", "_match").hint("merge"), ["_match", "_salt"], "left")
        .drop("_match", "_salt")
    )


def enrich_visits(visits: DataFrame, doctors: DataFrame, salts: int = 1) -> DataFrame:
    """The gold visit table: no patient identifiers, one row per visit and matching doctor."""
    joined = join_doctors(visits.select(*FROM_VISIT), doctors.select(*FROM_DOCTOR), salts)
    admitted = F.col("admission_datetime")
    gold = joined.withColumns({
        "department_referral": F.coalesce("department_referral", F.lit(NO_REFERRAL)),
        "coordinator_involved": F.col("coordinator_manager_flag").cast("int"),
        "admission_month": month_start(admitted),
        "admission_hour": F.hour(admitted),
        "weekday_num": F.dayofweek(admitted),
        "weekday": F.date_format(admitted, "E"),
        "age_group": band(F.col("age"), AGE_BANDS),
        "wait_bucket_in_mins": band(F.col("wait_time"), WAIT_BANDS),
        "experience_bucket_in_years": band(F.col("years_of_experience"), EXPERIENCE_BANDS),
    })
    return enforce_schema(gold, GOLD_VISITS)


def changed_doctors(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doctor_id`` of the doctors that came, went, or changed in a column that gold shows; repeated doctors count as often as given."""
    before, after = (d.select(*FROM_DOCTOR) for d in (before, after))
    return before.exceptAll(after).unionByName(after.exceptAll(before)).select("doctor_id").distinct()


def as_visits(gold: DataFrame) -> DataFrame:
    """The visits that gold rows were made of, once each, as far as gold needs them again."""
    return gold.dropDuplicates(["visit_id"]).withColumn("coordinator_manager_flag", F.col("coordinator_involved") == 1).select(*FROM_VISIT)


def visits_to_join_again(gold: DataFrame, feed: DataFrame, doctors_before: DataFrame, doctors_after: DataFrame) -> DataFrame:
    """Visits whose gold rows change: those that a feed brings in their new form, and those of changed doctors that it does not name.

    Changed visits meet all doctors, changed doctors meet the other visits, and no visit is in both: with the gold rows of
    the same visits taken away and these joined to ``doctors_after`` put in their place, gold is that of the whole join.
    ``gold`` needs only the rows of changed doctors.  The feed grows with the visits and is never broadcast.
    """
    came = feed.where("change <> 'update_preimage'").select(*FROM_VISIT)
    moved = gold.join(changed_doctors(doctors_before, doctors_after), "doctor_id", "left_semi")
    moved = moved.join(feed.select("visit_id").hint("merge"), "visit_id", "left_anti")
    return came.unionByName(as_visits(moved))
