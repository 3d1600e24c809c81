"""What several of the operators need: small batches, stored steps, folds and digests."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import scratch_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 256, most_bytes: int = 16 << 20) -> None:
    """Hand rows to Python in batches of ``rows`` and ``most_bytes`` at most: one batch is all a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def stored(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Later steps read files, so a lost executor costs the tasks it had and no earlier step.  With ``free`` the shuffle files of
    this step are deleted as soon as it is written, and not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, str(free or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value):
    """A broadcast of ``value`` as bytes, which a task opens with ``cloudpickle.loads``: with the classes of modules that are
    pickled by value, so that workers need no copy of them.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where the CRC-32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def joined_spans(spans: Column) -> Column:
    """An array of (kind, start, stop) structs as ``kind:start:stop`` texts joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
