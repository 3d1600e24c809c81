"""Files -> bronze table, as a stream that can stop, resume and start over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlake.schemas import BRONZE_VISITS
from wardlake.sources.csv_rows import envelopes, refuse_hidden, same_splits, stream_lines
from wardlake.sources.envelopes import counted, parse_lines, to_bronze

# Fixed value: seconds after which an intake run stops.
MAX_RUN_SECONDS = 120


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The lasting id of the streaming query with this checkpoint.

    Spark writes it when the checkpoint is made, so a resumed run has the same, while another
    stream, and a checkpoint made anew at an old path, have one of their own.
    """
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(
        F.get_json_object("value", "$.id").alias("id")
    ).where("id IS NOT NULL").first()["id"]


def place_of(path: str, run: str, batch_id: int) -> str:
    """Each batch of each run has a folder of its own: running a batch again replaces
    what it wrote and nothing else."""
    return f"{path}/run={run}/batch_id={batch_id}"


def _land_csv(source: str, bronze_path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        refuse_hidden(spark, source)
        run = run_of(spark, checkpoint)
        with same_splits(spark):
            records = envelopes(batch).withColumn("payload", F.parse_json("value"))
            to_bronze(records).write.mode("overwrite").parquet(place_of(bronze_path, run, batch_id))

    return land


def _land_json(bronze_path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        # Read, parsed and counted once; what follows reads the stored lines.
        incoming = place_of(f"{bronze_path}_incoming", run, batch_id)
        marked = to_bronze(batch, "value").withColumn("rejected", F.col("payload").isNull())
        marked.write.mode("overwrite").partitionBy("rejected").parquet(incoming)
        lines = spark.read.schema(f"{BRONZE_VISITS}, value STRING, rejected BOOLEAN").parquet(incoming)
        for part, path in (
            (lines.where("NOT rejected").select("payload", "timestamp_bronze"), bronze_path),
            (lines.where("rejected").select("value"), f"{bronze_path}_rejects"),
        ):
            part.write.mode("overwrite").parquet(place_of(path, run, batch_id))

    return land


def _start(
    lines: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    return (
        lines.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def csv_to_bronze(
    spark: SparkSession,
    source: str,
    bronze_path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Start reading the CSV files not yet read into bronze.

    The checkpoint holds the files done: the same one resumes, a folder of a new name
    reads all again (the upsert by key removes what is then read twice).  The run ends
    when all files there have been read, or with ``every`` looks for more at that interval.
    """
    land = _land_csv(source, bronze_path, checkpoint)
    return _start(stream_lines(spark, source, files_per_batch), land, checkpoint, every)


def json_lines_to_bronze(
    spark: SparkSession,
    source: str,
    bronze_path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    every: str | None = None,
    metrics: str = "lines",
) -> StreamingQuery:
    """Start reading newline-delimited JSON files; bad lines go to ``<bronze>_rejects``.

    The query's progress counts read and rejected lines of each batch under ``metrics``.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    land = _land_json(bronze_path, checkpoint)
    return _start(counted(parse_lines(reader.text(source)), metrics), land, checkpoint, every)


def run_for(query: StreamingQuery, seconds: int = MAX_RUN_SECONDS) -> bool:
    """Let a query work for that long at most; true when it finished by itself."""
    finished = query.awaitTermination(seconds)
    if not finished:
        query.stop()
    return bool(finished)


def read_bronze(spark: SparkSession, bronze_path: str) -> DataFrame:
    return spark.read.schema(BRONZE_VISITS).parquet(bronze_path).select("payload", "timestamp_bronze")
