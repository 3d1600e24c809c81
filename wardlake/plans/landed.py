"""The platform's tables over the given data, each landed once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.operators import corpus, retrieval, rollups
from wardlake.operators.access import LAYOUT, with_layout, without_layout
from wardlake.operators.enrich import enrich_visits
from wardlake.plans import testdata
from wardlake.plans.gold_refresh import GoldTables
from wardlake.plans.lake import current_visits, silver_doctors
from wardlake.session import scratch_dir, use_core_conf
from wardlake.sources.envelopes import to_bronze
from wardlake.streaming.current_state import CurrentVisits

# Splits the visits into two halves by arrival, and marks a state shortly before the end.
HALF_TIME, EARLIER_TIME = "2024-01-16", "2024-01-30T12"
OPENED, CLOSED = "Orthopedics", "Closed Ward"

_landed: dict[tuple[str, str, str], str] = {}


def _land(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by_group: bool = False
) -> DataFrame:
    use_core_conf(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        path = scratch_dir(spark, name)
        df = with_layout(build()) if by_group else build()
        df.write.partitionBy(*[c for c in LAYOUT.values() if c in df.columns]).parquet(path)
        _landed[key] = path
    return spark.read.parquet(_landed[key])


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        lines = testdata.visit_lines(spark, sf_dir)
        return to_bronze(lines.withColumn("payload", F.parse_json("value")), arrived=F.col("arrived"))

    return _land(spark, sf_dir, "bronze", build)


def visits(spark: SparkSession, sf_dir: str, laid_out: bool = False) -> DataFrame:
    """Partitioned by department group; ``laid_out`` leaves the partition columns in."""
    df = _land(spark, sf_dir, "visits", lambda: current_visits(bronze(spark, sf_dir)), by_group=True)
    return df if laid_out else without_layout(df)


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, so that the join knows its size before it runs."""
    return _land(
        spark, sf_dir, "doctors", lambda: silver_doctors(testdata.doctors_raw(spark, sf_dir))
    )


def gold(spark: SparkSession, sf_dir: str, laid_out: bool = False) -> DataFrame:
    """Partitioned by the groups of both departments; ``laid_out`` leaves the partition columns in."""
    df = _land(
        spark, sf_dir, "gold", lambda: enrich_visits(visits(spark, sf_dir), doctors(spark, sf_dir)), by_group=True
    )
    return df if laid_out else without_layout(df)


def rollup(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rollups.rollup(gold(spark, sf_dir), name)


def insight_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.insight_docs(
        rollup(spark, sf_dir, "department_monthly_stats"), rollup(spark, sf_dir, "doctor_performance")
    )


def insight_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with the vector of every text."""

    def build() -> DataFrame:
        vector = retrieval.hashed_words()(F.col("text"))
        return insight_docs(spark, sf_dir).withColumn("vector", vector)

    return _land(spark, sf_dir, "insight_vectors", build)


def earlier_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it stood some hours before the end: with a department that has
    closed since and without one that has opened since."""

    def build() -> DataFrame:
        then = bronze(spark, sf_dir).where(F.col("timestamp_bronze") < EARLIER_TIME)
        past = enrich_visits(current_visits(then), doctors(spark, sf_dir))
        monthly = rollups.department_monthly_stats(past)
        department = F.when(
            F.col("department_referral") == OPENED, F.lit(CLOSED)
        ).otherwise(F.col("department_referral"))
        renamed = monthly.withColumn("department_referral", department)
        return corpus.insight_docs(renamed, rollups.doctor_performance(past))

    return _land(spark, sf_dir, "earlier_docs", build)


def earlier_doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doctors of some time ago: some in other departments, some not there yet, one since gone."""
    number = F.expr("try_cast(substring(doctor_id, 5) AS int)")
    then = doctors(spark, sf_dir).where(number.isNull() | (number % 11 != 0))
    then = then.withColumn("department", F.when(number % 7 == 0, F.lit(CLOSED)).otherwise(F.col("department")))
    gone = then.limit(1).withColumn("doctor_id", F.lit("DOC-GONE"))
    return then.unionByName(gone)


def refreshed_gold(spark: SparkSession, sf_dir: str) -> GoldTables:
    """Gold as it was at half time, taken to now by what has changed since: once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "refreshed_gold")
    if key not in _landed:
        path = scratch_dir(use_core_conf(spark), "refreshed-gold")
        first = bronze(spark, sf_dir).where(F.col("timestamp_bronze") < HALF_TIME)
        late = bronze(spark, sf_dir).where(F.col("timestamp_bronze") >= HALF_TIME)
        table = CurrentVisits(spark, f"{path}/visits", slices=2)
        tables = GoldTables(spark, f"{path}/gold")
        for version, part in enumerate((first, late)):
            table.apply(current_visits(part), version, run="refresh")
            if version == 0:
                tables.start(table.read(), earlier_doctors(spark, sf_dir))
            else:
                tables.apply(table.feed(version, "refresh"), doctors(spark, sf_dir), version)
        _landed[key] = path
    return GoldTables(spark, f"{_landed[key]}/gold")
