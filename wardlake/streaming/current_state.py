"""Current state by key (SCD type 1), kept by a stream in a partitioned parquet table.

The table is split by the month of admission and, within a month, by slices of the
key.  Both follow from the key, so a batch can only change the partitions its own
keys fall in; the others are neither read nor written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardlake.operators.patients import clean_visits
from wardlake.operators.quality import VISIT_RULES, expect
from wardlake.operators.upsert import VISIT_SEQUENCE, change_rows, latest_by_key, upserted
from wardlake.schemas import SILVER_VISITS, enforce_schema
from wardlake.streaming.intake import place_of, run_of

PLACE = ["admission_period", "key_slice"]
STORED = f"{SILVER_VISITS}, admission_period STRING, key_slice INT"
FEED = f"change STRING, {SILVER_VISITS}"
STAGED = f"{STORED}, _before STRUCT<{SILVER_VISITS}>, _change STRING"
# The run of batches that come from no stream.
DIRECT = "direct"
MAX_NAMED_PARTITIONS = 10_000
# Rows of one partition that one task merges, about.
ROWS_PER_TASK = 2_000_000


def place_columns(slices: int) -> dict[str, Column]:
    """Partition columns of a visit.  The key holds the admission time, so they follow from it."""
    period = F.date_format("admission_datetime", "yyyy-MM")
    return {
        "admission_period": F.coalesce(period, F.lit("undated")),
        "key_slice": F.pmod(F.xxhash64("visit_id"), F.lit(slices)).cast("int"),
    }


def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class CurrentVisits:
    """The visit table at ``path``; ``apply`` is a ``foreachBatch`` function.

    A batch is first merged into a staging table next to the table, then the staged
    partitions replace those of the table.  A note says in between that the staging
    table is complete: after a crash the next run first replaces the partitions from
    it again, then merges its batch.  Merging a batch twice changes nothing.

    A batch is first written as it comes, so that it is computed once and its rows are where all
    executors can read them.  Rows without a sequence value go to the quarantine table, in a folder of their run and batch.

    The rows that a batch changed go to a change feed, one folder per run and batch: the row before and the row after an update,
    new rows as they are.  They come out of the same merge.  A batch of a stream that is already in the table
    is not merged again, so its feed stays as it was.

    While a batch is published its partitions are replaced one after the other: who reads the table then may see some of
    the batch, or fail and should read again.

    ``slices`` sets how finely a batch can pick what to rewrite and stays with the
    table.  ``spread`` sets how many tasks (and files) share one partition and may
    change; if not given each partition gets its own number, by its rows, so that a task gets about ``rows_per_task`` and
    a small partition is one file.
    """

    def __init__(
        self, spark: SparkSession, path: str, slices: int = 64, spread: int | None = None, rows_per_task: int = ROWS_PER_TASK
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.slices, self.spread, self.rows_per_task = slices, spread, rows_per_task
        self.incoming = f"{self.path}_incoming"
        self.staging, self.note, self.applied = f"{self.path}_staging", f"{self.path}_staged", f"{self.path}_applied"
        self.quarantine, self.changes = f"{self.path}_quarantine", f"{self.path}_changes"

    def read(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.path).drop(*PLACE)

    def feed(self, batch_id: int, run: str = DIRECT) -> DataFrame:
        """What a batch changed: ``change`` and the columns of a visit."""
        return self.spark.read.schema(FEED).parquet(place_of(self.changes, run, batch_id))

    def apply(self, batch: DataFrame, batch_id: int, run: str = DIRECT) -> None:
        self._finish()
        if run != DIRECT and self._last_of(run) >= batch_id:
            return
        marked = batch.withColumn("_sequenced", F.col(VISIT_SEQUENCE).isNotNull())
        marked.write.mode("overwrite").partitionBy("_sequenced").parquet(self.incoming)
        came = self.spark.read.schema(f"{SILVER_VISITS}, _sequenced BOOLEAN").parquet(self.incoming)
        held = came.where("NOT _sequenced").drop("_sequenced")
        held.write.mode("overwrite").parquet(place_of(self.quarantine, run, batch_id))
        merged = self._merge(came.where("_sequenced").drop("_sequenced"))
        merged.write.mode("overwrite").partitionBy(*PLACE).parquet(self.staging)
        self._note(True, run, batch_id)
        self._finish()

    def _merge(self, batch: DataFrame) -> DataFrame:
        """New content of the touched partitions, each in as many tasks as its rows need, and what changed in it."""
        places = batch.withColumns(place_columns(self.slices)).groupBy(*PLACE).agg(F.count("*").alias("n"))
        placed = latest_by_key(batch).withColumns(place_columns(self.slices)).withColumn("_new", F.lit(True))
        current = _read_or_none(self.spark, self.path, STORED)
        sizes = places
        if current is not None:
            old = self._partitions_of(current, places).withColumn("_new", F.lit(False))
            placed = placed.unionByName(old.select(*placed.columns))
            sizes = places.unionByName(old.groupBy(*PLACE).agg(F.count("*").alias("n")))
        if self.spread is None:
            tasks = F.ceil(F.sum("n") / self.rows_per_task).cast("int")
            # Most partitions are one task, as those not listed are.
            large = sizes.groupBy(*PLACE).agg(tasks.alias("_tasks")).where("_tasks > 1")
            placed = placed.join(large, PLACE, "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1)))
        else:
            placed = placed.withColumn("_tasks", F.lit(self.spread))
        placed = placed.withColumn("_share", F.pmod(F.hash("visit_id"), F.col("_tasks"))).drop("_tasks")
        shared = placed.repartition(*PLACE, "_share")
        return upserted(shared, within=[*PLACE, "_share"]).drop("_share")

    def _partitions_of(self, current: DataFrame, places: DataFrame) -> DataFrame:
        """The rows of the current table in partitions that the batch has rows for.

        The names of up to ``MAX_NAMED_PARTITIONS`` become a partition filter of the scan.
        A batch that touches more leaves little to skip: a plain join picks the rows.
        """
        touched = places.select(*PLACE)
        names = touched.take(MAX_NAMED_PARTITIONS + 1)
        if len(names) > MAX_NAMED_PARTITIONS:
            return current.join(touched, PLACE, "left_semi")
        period, key_slice = (F.col(name) for name in PLACE)
        scan = current.where(
            period.isin([n.admission_period for n in names])
            & key_slice.isin([n.key_slice for n in names])
        )
        named = self.spark.createDataFrame(names, touched.schema)
        return scan.join(F.broadcast(named), PLACE, "left_semi")

    def _finish(self) -> None:
        """Publish what is staged, if anything is: the feed, then the table, then a note of the batch."""
        note = _read_or_none(self.spark, self.note, "staged BOOLEAN, run STRING, batch_id BIGINT")
        for staged in note.where("staged").take(1) if note is not None else []:
            columns = StructType.fromDDL(SILVER_VISITS).names
            changed = change_rows(self.spark.read.schema(STAGED).parquet(self.staging), columns)
            changed.write.mode("overwrite").parquet(place_of(self.changes, staged["run"], staged["batch_id"]))
            self._publish()
            self._one_row(F.lit(staged["batch_id"]).alias("batch_id")).parquet(f"{self.applied}/run={staged['run']}")
            self._note(False, staged["run"], staged["batch_id"])

    def _publish(self) -> None:
        (
            self.spark.read.schema(STORED).parquet(self.staging)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PLACE)
            .parquet(self.path)
        )

    def _one_row(self, *columns: Column):
        return self.spark.range(1, numPartitions=1).select(*columns).write.mode("overwrite")

    def _note(self, staged: bool, run: str, batch_id: int) -> None:
        named = {"staged": staged, "run": run, "batch_id": batch_id}
        self._one_row(*[F.lit(value).alias(name) for name, value in named.items()]).parquet(self.note)

    def _last_of(self, run: str) -> int:
        """The last batch of a run that is in the table, -1 before the first."""
        last = _read_or_none(self.spark, f"{self.applied}/run={run}", "batch_id BIGINT")
        return -1 if last is None else last.first()["batch_id"]


def visits_upsert(
    bronze: DataFrame,
    table: CurrentVisits,
    checkpoint: str,
    metrics: str = "visit_rules",
    every: str | None = None,
) -> StreamingQuery:
    """Start cleaning a bronze stream and keeping the table current with it.

    It stops when all that is there has been read, or with ``every`` (such as
    ``"1 minute"``) looks for more at that interval.  Rule failures are counted per
    batch under ``metrics`` in the query's progress.
    """
    visits = enforce_schema(clean_visits(bronze), SILVER_VISITS)

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, run_of(batch.sparkSession, checkpoint))

    return (
        expect(visits, VISIT_RULES, metrics)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )
