"""Batch and streaming scans of stored tables, and the federated doctor scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlake.schemas import BRONZE_VISITS


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_table(
    spark: SparkSession,
    path: str,
    schema: str = BRONZE_VISITS,
    files_per_batch: int | None = None,
    bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """A stored table as a stream of its files, so many files or bytes of them per batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


def register_table(
    spark: SparkSession,
    name: str,
    path: str,
    schema: str,
    comment: str = "",
    properties: dict[str, str] | None = None,
    partitioned_by: list[str] | None = None,
) -> DataFrame:
    """Give stored parquet files a table name, declared schema, comment and properties."""

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    listed = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in (properties or {}).items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        + (f"PARTITIONED BY ({', '.join(partitioned_by)}) " if partitioned_by else "")
        + f"LOCATION {quoted(path)} COMMENT {quoted(comment)}"
        + (f" TBLPROPERTIES ({listed})" if listed else "")
    )
    if partitioned_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    splits: int | None = None,
) -> DataFrame:
    """A whole table of a database, read in parallel ranges of ``split_column`` if given.

    Rows outside ``bounds`` are read too: they go to the first and last range.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_column:
        if bounds is None or splits is None:
            raise ValueError("split_column needs bounds and splits")
        reader = (
            reader.option("partitionColumn", split_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", splits)
        )
    return reader.options(**(properties or {})).load()
