"""CSV rows -> bronze in batches of bounded rows, with a state that knows the row it stands at."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.sources.csv_rows import CSV_NAMES, read_rows, refuse_hidden
from wardlake.sources.envelopes import OVERLAP_ROWS, to_bronze
from wardlake.streaming.intake import MAX_RUN_SECONDS, place_of

ROWS_PER_BATCH = 50_000_000
# Files are parsed together until they have so many bytes; a larger file is parsed alone.
WINDOW_BYTES = 64 << 30
STATE = "file STRING, row BIGINT, finished BOOLEAN, batch_id BIGINT"


class Slice(NamedTuple):
    """Rows of a file: those after ``after`` up to ``upto``; ``finished`` if these are its last."""

    file: str
    after: int
    upto: int
    finished: bool


def slices(files: list[tuple[str, int, int]], most_rows: int) -> list[list[Slice]]:
    """Batches of at most ``most_rows`` rows of ``(file, rows read before, rows)``, in order."""
    batches: list[list[Slice]] = [[]]
    room = most_rows
    for file, after, rows in files:
        while True:
            upto = min(rows, after + room)
            if upto > after or rows <= after:
                batches[-1].append(Slice(file, after, upto, upto >= rows))
                room -= max(upto - after, 0)
            if upto >= rows:
                break
            after = upto
            batches.append([])
            room = most_rows
    return [b for b in batches if b]


class RowIntake:
    """Reads the CSV files of ``source`` into bronze, file after file by name, row after row.

    After each batch the state at ``state_path`` gets the files it finished and the row at which it stopped inside a file.  A
    later run begins with that file, ``overlap`` rows before that row, then takes the files not yet finished by name; rows sent again are
    removed by the upsert.  A new state folder reads everything again.

    A batch is landed in a folder of its own, then noted: a run that dies in between lands the same folder anew.  Files are
    parsed once per run, by all tasks together, into the scratch folder; batches are slices of that.  One intake at a time may use a state.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        bronze_path: str,
        state_path: str,
        rows_per_batch: int = ROWS_PER_BATCH,
        overlap: int = OVERLAP_ROWS,
        window_bytes: int = WINDOW_BYTES,
    ):
        self.spark, self.source = spark, source.rstrip("/")
        self.bronze_path, self.state_path = bronze_path, state_path.rstrip("/")
        self.rows_per_batch, self.overlap, self.window_bytes = rows_per_batch, overlap, window_bytes

    def state(self) -> DataFrame:
        """``file, row, finished, batch_id``: how far each batch came in each of its files."""
        try:
            return self.spark.read.schema(STATE).parquet(self.state_path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def pending(self) -> list[tuple[str, int, int]]:
        """``(path, bytes, rows read before)`` of the files not finished: the one a run stopped in, then the others by name."""
        refuse_hidden(self.spark, self.source)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", CSV_NAMES).load(self.source).select(
            "path", "length", F.element_at(F.split("path", "/"), -1).alias("file")
        )
        seen = self.state().groupBy("file").agg(F.max_by("row", "batch_id").alias("row"), F.max("finished").alias("finished"))
        left = files.join(seen, "file", "left").where("finished IS NULL OR NOT finished")
        return [(r["path"], r["length"], r["row"] or 0) for r in left.orderBy(F.col("row").isNull(), "file").collect()]

    def run(self, batches: int | None = None, seconds: int | None = MAX_RUN_SECONDS) -> int:
        """Land what is there, or so many batches of it, or what can be begun in so many seconds; returns the batches landed."""
        began, landed = time.monotonic(), 0
        last = self.state().agg(F.max("batch_id")).first()[0]
        batch_id = 0 if last is None else last + 1
        left = [(path, size, max(0, row - self.overlap)) for path, size, row in self.pending()]
        while left:
            window, size = [], 0
            while left and (not window or size + left[0][1] <= self.window_bytes):
                window.append(left.pop(0))
                size += window[-1][1]
            rows = read_rows(self.spark, [path for path, _, _ in window])
            counts = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.max("row").alias("n")).collect()}
            names = [(path.rsplit("/", 1)[1], after) for path, _, after in window]
            for batch in slices([(name, after, counts.get(name, 0)) for name, after in names], self.rows_per_batch):
                if (batches is not None and landed >= batches) or (seconds is not None and time.monotonic() - began > seconds):
                    return landed
                self._land(rows, batch, batch_id)
                batch_id, landed = batch_id + 1, landed + 1
        return landed

    def _land(self, rows: DataFrame, batch: list[Slice], batch_id: int) -> None:
        ranges = self.spark.createDataFrame(batch, "file STRING, after BIGINT, upto BIGINT, finished BOOLEAN")
        # Parsed rows lie in files by number: those of other batches are skipped.
        near = rows.where((F.col("row") > min(s.after for s in batch)) & (F.col("row") <= max(s.upto for s in batch)))
        due = near.join(F.broadcast(ranges), "file").where("row > after AND row <= upto")
        records = due.withColumn("payload", F.parse_json("value"))
        to_bronze(records).write.mode("overwrite").parquet(place_of(self.bronze_path, "rows", batch_id))
        note = ranges.select("file", F.col("upto").alias("row"), "finished").coalesce(1)
        note.write.mode("overwrite").parquet(f"{self.state_path}/batch_id={batch_id}")
