"""The given tables in the shapes of the visit platform.

``events`` become bronze visits and ``supplier`` with ``nation`` become doctors.
Every row is used; faults (marker texts, bad dates, odd numbers) are spread over
the rows by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions.times import ADMISSION_PATTERNS
from wardlake.operators.access import ADMIN_GROUP
from wardlake.operators.reports import CHART_DEPARTMENTS
from wardlake.session import use_core_conf
from wardlake.sources.envelopes import OVERLAP_ROWS

# Of so many rows the last ones come once more, an hour later.
RESENT_EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_core_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small table out to the cores; one with as many partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _pick(number: Column, *choices: str | Column) -> Column:
    """The choice at ``number`` modulo the number of choices."""
    chain = F
    for at, choice in enumerate(choices):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        chain = chain.when(number % len(choices) == at, value)
    return chain


def visit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of text cells per event, with its row number and arrival time."""
    event, user = F.col("event_id"), F.col("user_id")
    t = F.expr("ts + make_dt_interval(CAST((user_id % 12) * 30 AS INT))")
    age = F.get_json_object("props", "$.k")

    def every(n: int) -> Column:
        return event % n == 0

    return spread(table(spark, sf_dir, "events"), "event_id").select(
        F.when(every(97), "N/A").otherwise(F.concat(F.lit("P"), user)).alias("patient_id"),
        _pick(event, *[F.date_format(t, f) for f in ADMISSION_PATTERNS], "not-a-date").alias(
            "patient_admission_date"
        ),
        _pick(event, "ab", "Q", " x", "").alias("patient_first_inital"),
        _pick(user, "SMITH", "o'neil", "de la CRUZ", "Jones-lee", "None").alias("patient_last_name"),
        _pick(event, "Male", "f", "F", "Unknown", "x").alias("patient_gender"),
        F.when(every(37), "abc").when(every(41), "130")
        .when(every(3), F.concat(age, F.lit(".7"))).otherwise(age).alias("patient_age"),
        _pick(event, "white", "BLACK", "asian", "native american", "N/A", "other").alias("patient_race"),
        _pick(
            event, "cardiology", "NEUROLOGY", "Orthopedics", "physiotherapy", "N/A",
            *[F.col("event_type")] * 3, "general practice",
        ).alias("department_referral"),
        _pick(event, "Y", "yes", "true", "1", "N", "false", "0", "maybe").alias("patient_admission_flag"),
        F.when(every(11), "").otherwise((event * 7 % 13).cast("string")).alias("patient_satisfaction_score"),
        F.when(every(53), "-5").otherwise(F.floor("value").cast("string")).alias("patient_waittime"),
        _pick(event, "true", "false", "N/A").alias("patients_cm"),
        F.concat(F.lit("DOC-"), user).alias("doctor_id"),
        F.lit("events.csv").alias("file"),
        (event + 1).cast("int").alias("row"),
        F.col("ts").cast("timestamp").alias("arrived"),
    )


def visit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row, value, arrived``: the JSON text of each visit; some rows are sent twice."""
    cells = visit_cells(spark, sf_dir)
    text = F.to_json(F.struct(*[c for c in cells.columns if c != "arrived"]))
    sent = cells.select("row", text.alias("value"), "arrived")
    resent = F.pmod(F.col("row") - 1, F.lit(RESENT_EVERY)) >= RESENT_EVERY - OVERLAP_ROWS
    hours = F.when(resent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = sent.withColumn("hours", F.explode(hours))
    return sent.withColumn("arrived", F.expr("arrived + make_dt_interval(0, hours)")).drop("hours")


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines, some of them cut short, empty, or with text after the end."""
    number = F.col("row") - 1
    value = (
        F.when(number % 101 == 0, "")
        .when(number % 103 == 0, F.substring("value", 1, 40))
        .when(number % 107 == 0, F.concat("value", F.lit(" x")))
        .otherwise(F.col("value"))
    )
    return visit_lines(spark, sf_dir).withColumn("value", value)


def doctors_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One doctor per supplier, as an operational database might hold them."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.when(key % 37 != 36, F.when(key % 43 == 42, F.concat(F.lit("BAD"), key))
               .otherwise(F.concat(F.lit(" doc-"), key, F.lit(" ")))).alias("doctor_id"),
        F.lit(" ethan ").alias("doctor_first_name"),
        F.when(key % 41 != 40, F.col("s_name")).alias("doctor_last_name"),
        _pick(F.col("s_nationkey"), *[f" {d.lower()} " for d in CHART_DEPARTMENTS]).alias("department"),
        F.col("n_name").alias("subspecialty"),
        F.concat(F.lit("U"), key % 5).alias("university"),
        F.when(key % 29 == 28, -1).otherwise(key % 30).cast("int").alias("years_of_experience"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reader, group``: one reader per nation, most of them in two departments, every ninth an admin."""
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    first = _pick(key, *[f"dept_{d.lower().replace(' ', '_')}" for d in CHART_DEPARTMENTS])
    second = F.when(key % 9 == 8, F.lit(ADMIN_GROUP)).otherwise(F.lit("dept_cardiology"))
    return nation.select(F.col("n_name").alias("reader"), F.explode(F.array(first, second)).alias("group"))
