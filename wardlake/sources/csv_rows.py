"""CSV files -> one JSON text per data row, whatever header each file has.

Files are read as lines, so a large file is split over many tasks.  The number of
a row is the lines before it in its own split plus the lines of the splits ahead,
which a small count table gives.  A quoted cell may hold commas, doubled quotes and line breaks.
Where a quote stays open at the end of a line, the file's splits are first read for what each does to
a reader that enters it outside or inside a quoted cell; put one after the other, these
say how each split is entered, and then all tasks cut their own splits into records.  Only records that
lie over several splits are put together by a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.session import scratch_dir, use_checkpoint_dir

# Python workers get the functions of this module with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The file name endings that are read, in any case.
CSV_NAMES = "*.{[cC][sS][vV],[tT][xX][tT]}"

# One cell after its comma: an optional quoted part (quotes doubled inside), then
# anything up to the next comma.  Possessive, so long cells need no deep stack.
_CELL = r',((?:"[^"]*+(?:""[^"]*+)*+")?+[^,]*+)'
# A line whose last cell begins with a quote that nothing closes.
_OPEN = r'\A(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+,|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+\z'
_FILE, _SPLIT, _NAME, _SIZE = "_file", "_split", "_name", "_size"

# Up to this size the tables of splits and headers are broadcast; above it they are joined by shuffle.
BROADCAST_BYTES = 256 << 20
SPLIT_SETTING = "spark.sql.files.minPartitionNum"


def _file_columns() -> list[Column]:
    meta = F.col("_metadata")
    return [
        meta["file_path"].alias(_FILE),
        meta["file_name"].alias(_NAME),
        meta["file_block_start"].alias(_SPLIT),
        meta["file_size"].alias(_SIZE),
    ]


def refuse_hidden(spark: SparkSession, path: str) -> None:
    """An error that names the CSV files which Spark would skip for a leading ``_`` or ``.``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(place, f"[_.]{CSV_NAMES}")
    )
    names = sorted(f.getPath().getName() for f in found or [])
    if names:
        raise ValueError(f"rename these files, whose names make Spark skip them: {', '.join(names)}")


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Within this, files are cut into the same splits whatever cores there are at the moment."""
    unset = not spark.conf.get(SPLIT_SETTING, None)
    if unset:
        spark.conf.set(SPLIT_SETTING, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(SPLIT_SETTING)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of all CSV files of a folder, or of the files named, with file and split.

    A line ends at a line feed; a carriage return before it stays, as it may belong to a cell.
    """
    if isinstance(path, str):
        refuse_hidden(spark, path)
    reader = spark.read.option("pathGlobFilter", CSV_NAMES).option("lineSep", "\n")
    return reader.text(path).select("value", *_file_columns())


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of files; the checkpoint remembers the files done."""
    refuse_hidden(spark, path)
    reader = spark.readStream.option("pathGlobFilter", CSV_NAMES).option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select("value", *_file_columns())


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the CSV files of a folder, sorted; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", CSV_NAMES).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy("file")


def header_name(cell: Column) -> Column:
    """A header cell as key: no outer white space, lower case, blanks as underscores."""
    stripped = F.regexp_replace(cell, r"^\s+|\s+$", "")
    return F.replace(F.lower(stripped), F.lit(" "), F.lit("_"))


def split_cells(line: Column) -> Column:
    """The cells of a CSV line; an empty line has none."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    quoted_part = r'^"([^"]*+(?:""[^"]*+)*+)"([^,]*+)$'

    def unquote(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, quoted_part, 1), F.lit('""'), F.lit('"'))
        tail = F.regexp_extract(cell, quoted_part, 2)
        return F.when(cell.rlike(quoted_part), F.concat(inner, tail)).otherwise(cell)

    # Most lines hold no quote at all and skip the second pass over their cells.
    cells = F.when(F.contains(line, F.lit('"')), F.transform(raw, unquote)).otherwise(raw)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(cells)


def _closed(text: Column) -> Column:
    """A record as the csv module leaves it: without carriage returns at its end."""
    return F.when(F.endswith(text, F.lit("\r")), F.regexp_replace(text, r"\r+\z", "")).otherwise(text)


def _split_table(placed: DataFrame) -> DataFrame:
    """One row per split: its lines and bytes, its first place, and whether a quote stays open at a line's end.

    Kept as a checkpoint, so the lines are read once whatever is done with it.
    """
    use_checkpoint_dir(placed.sparkSession)
    return placed.groupBy(_FILE, _SPLIT).agg(
        F.count("*").alias("_lines"),
        F.sum(F.octet_length("value") + 1).alias("_bytes"),
        F.max(_SIZE).alias(_SIZE),
        F.min("_place").alias("_start"),
        F.min_by(F.when(F.col(_SPLIT) == 0, F.col("value")), "_place").alias("_first"),
        F.max(F.contains("value", F.lit('"')) & F.col("value").rlike(_OPEN)).alias("_open"),
    ).checkpoint()


def _joined(lines: DataFrame, table: DataFrame, keys: list[str], row_bytes: Column) -> DataFrame:
    """``lines`` with a small table by file: broadcast, in which case they keep their order, up to a checked size."""
    size = table.agg(F.sum(row_bytes)).first()[0] or 0
    return lines.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, keys)


def _header(first: Column) -> Column:
    return F.transform(split_cells(_closed(first)), header_name)


def line_records(placed: DataFrame, splits: DataFrame) -> DataFrame:
    """``_name, row, header, value`` of files in which every line is a record; row 0 is the header."""
    ahead = Window.partitionBy(_FILE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select(
        _FILE, _SPLIT, (F.coalesce(F.sum("_lines").over(ahead), F.lit(0)) - F.col("_start")).alias("_shift")
    )
    files = splits.groupBy(_FILE).agg(_header(F.max("_first")).alias("header"), F.max("_open").alias("_open"))
    files = files.where("NOT _open").drop("_open")
    numbered = _joined(placed, files, [_FILE], F.length(_FILE) + F.length(F.array_join("header", ",")) + 32)
    size = shifts.agg(F.sum(F.length(_FILE) + 32)).first()[0] or 0
    numbered = numbered.join(F.broadcast(shifts) if size <= BROADCAST_BYTES else shifts, [_FILE, _SPLIT], "left")
    row = F.when(F.col("_shift").isNotNull(), F.col("_place") + F.col("_shift"))
    moved = F.raise_error(F.lit("file splits changed: spark.sql.files settings differ")).cast("bigint")
    return numbered.select(_NAME, F.coalesce(row, moved).alias("row"), "header", _closed(F.col("value")).alias("value"))


def _effects(lines: DataFrame) -> DataFrame:
    """Per line, whether a quoted cell is open after it: ``opens`` if none was before, ``stays`` if one was."""
    quoted, value = F.contains("value", F.lit('"')), F.col("value")
    return lines.withColumns({
        "opens": quoted & value.rlike(_OPEN),
        "stays": ~quoted | F.concat(F.lit('"'), value).rlike(_OPEN),
    })


def _split_effects(lines: DataFrame) -> DataFrame:
    """``_file, _split``, and for a reader that enters the split outside (0) or inside (1) a quoted cell: how it leaves
    the split (``exit0, exit1``) and how many records begin on the way (``begun0, begun1``)."""
    names = ["exit0", "exit1", "begun0", "begun1"]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            files, splits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            opens = batch.column(2).to_numpy(zero_copy_only=False)
            stays = batch.column(3).to_numpy(zero_copy_only=False)
            codes = files.indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                key = (files.dictionary[int(codes[a])].as_py(), int(splits[a]))
                state = found.setdefault(key, [0, 1, 0, 0])
                # Other lines leave either reader as it was.
                turns = np.flatnonzero(opens[a:b] | ~stays[a:b])
                for entered in (0, 1):
                    inside, begun, at = state[entered], state[2 + entered], 0
                    for turn in turns.tolist():
                        begun += 0 if inside else turn + 1 - at
                        inside, at = int((stays if inside else opens)[a + turn]), turn + 1
                    state[entered], state[2 + entered] = inside, begun + (0 if inside else b - a - at)
        rows = [{_FILE: file, _SPLIT: split, **dict(zip(names, state))} for (file, split), state in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(_FILE, pa.string()), (_SPLIT, pa.int64()), *((n, pa.int64()) for n in names)]))

    return lines.select(_FILE, _SPLIT, "opens", "stays").mapInArrow(
        sum_up, f"{_FILE} string, {_SPLIT} bigint, " + ", ".join(f"{n} bigint" for n in names)
    )


def _entries(effects: DataFrame) -> DataFrame:
    """How each split is entered: ``_file, _split, inside, before`` (records begun ahead of it), and per file
    whether its last record stays ``unclosed`` and how many ``records`` it has.  One short list per file is folded."""
    listed = effects.groupBy(_FILE).agg(
        F.array_sort(F.collect_list(F.struct(_SPLIT, "exit0", "exit1", "begun0", "begun1"))).alias("parts")
    )
    entry = "inside: bigint, before: bigint, at: array<struct<_split: bigint, inside: bigint, before: bigint>>"

    def step(done: Column, part: Column) -> Column:
        inside = done["inside"] == 1
        here = F.struct(part[_SPLIT].alias(_SPLIT), done["inside"].alias("inside"), done["before"].alias("before"))
        return F.struct(
            F.when(inside, part["exit1"]).otherwise(part["exit0"]).alias("inside"),
            (done["before"] + F.when(inside, part["begun1"]).otherwise(part["begun0"])).alias("before"),
            F.concat(done["at"], F.array(here)).alias("at"),
        ).cast(f"struct<{entry}>")

    none = F.struct(F.lit(0).alias("inside"), F.lit(0).alias("before"), F.array().alias("at")).cast(f"struct<{entry}>")
    folded = listed.select(_FILE, F.aggregate("parts", none, step).alias("end"))
    return folded.select(
        _FILE, F.col("end.before").alias("records"), (F.col("end.inside") == 1).alias("unclosed"), F.inline("end.at")
    )


def _pieces(lines: DataFrame) -> DataFrame:
    """``_file, _name, record, _split, whole, text``: what each split holds of each of its records.

    The lines of a split come in order, each with how its split is entered.
    """
    schema = pa.schema([
        (_FILE, pa.string()), (_NAME, pa.string()), ("record", pa.int64()), (_SPLIT, pa.int64()), ("whole", pa.bool_()), ("text", pa.string()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place, parts, record, inside, began = None, [], -1, False, False

        def piece(whole: bool) -> None:
            out.append((place[0], name, record, place[1], whole, "\n".join(parts)))
            parts.clear()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for file, split, own_name, value, opens, stays, entered, before in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (file, split):
                    if parts:
                        piece(False)
                    place, name, record, inside = (file, split), own_name, before - 1, entered == 1
                    began = not inside
                if not inside:
                    record, began = record + 1, True
                parts.append(value)
                inside = stays if inside else opens
                if not inside:
                    piece(began)
            if len(out) > 500:
                yield rows()
        if parts:
            piece(False)
        if out:
            yield rows()

    picked = lines.select(_FILE, _SPLIT, _NAME, "value", "opens", "stays", "inside", "before")
    return picked.mapInArrow(cut, f"{_FILE} string, {_NAME} string, record bigint, {_SPLIT} bigint, whole boolean, text string")


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_records(placed: DataFrame, splits: DataFrame) -> DataFrame:
    """``_name, row, header, value`` of files with line breaks in cells, from their lines; each split by its own task.

    A quote that nothing closes runs to the end of its file, as in the csv module.
    """
    by_file = splits.groupBy(_FILE).agg(
        F.max("_open").alias("_open"), (F.sum("_bytes") - F.max(_SIZE)).alias("over")
    ).where("_open").select(_FILE, "over")
    lines = _effects(_joined(placed, by_file, [_FILE], F.length(_FILE) + 32))
    entries = _kept(_entries(_split_effects(lines)), "csv-entries")
    by_split = entries.select(_FILE, _SPLIT, "inside", "before")
    size = by_split.agg(F.sum(F.length(_FILE) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        entered = lines.join(F.broadcast(by_split), [_FILE, _SPLIT])
    else:
        entered = lines.join(by_split, [_FILE, _SPLIT]).repartition(_FILE, _SPLIT).sortWithinPartitions(_FILE, _SPLIT, "_place")
    pieces = _kept(_pieces(entered), "csv-pieces")
    whole = pieces.where("whole").select(_FILE, _NAME, "record", "text")
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_SPLIT, "text"))), lambda p: p["text"]), "\n")
    cut = pieces.where("NOT whole").groupBy(_FILE, _NAME, "record").agg(together.alias("text"))
    ends = entries.select(_FILE, "records", "unclosed").distinct().join(by_file, _FILE)
    records = _joined(whole.unionByName(cut), ends, [_FILE], F.length(_FILE) + 32)
    # The lines' bytes with a line feed each are the file's, or one more if its last line has none.
    feed = F.when(F.col("over") > 0, "").otherwise("\n")
    last = F.col("unclosed") & (F.col("record") == F.col("records") - 1)
    value = F.when(last, F.concat("text", feed, F.lit('"'))).otherwise(_closed(F.col("text")))
    records = records.select(_FILE, _NAME, F.col("record").alias("row"), value.alias("value"))
    headers = records.where("row = 0").select(_FILE, _header(F.col("value")).alias("header"))
    headers = _kept(headers, "csv-headers")
    numbered = _joined(records, headers, [_FILE], F.length(_FILE) + F.length(F.array_join("header", ",")) + 32)
    return numbered.select(_NAME, "row", "header", "value")


def _json_text(text: Column) -> Column:
    return _inside(F.to_json(F.array(text)))


def _inside(enclosed: Column) -> Column:
    return F.substring(enclosed, F.lit(2), F.length(enclosed) - 2)


def _last_of_name(keys: Column, cells: Column) -> Column:
    """Map of keys to cells where names repeat."""
    pairs = F.arrays_zip(keys.alias("key"), cells.alias("value"))

    def is_last(pair: Column, at: Column) -> Column:
        return ~F.array_contains(F.slice(keys, at + 2, F.size(keys)), pair["key"])

    return F.map_from_entries(F.filter(pairs, is_last))


def envelopes(lines: DataFrame) -> DataFrame:
    """``file, row, value``: each data row as JSON text of its file, row number and cells.

    A cell without header name and a name without cell are left out.  Of equal
    names the last one counts, and a column named ``file`` or ``row`` replaces the
    file's own.

    A first pass over the lines runs at once.  The passes must cut the files alike: run this, and what is done with the rows, within
    ``same_splits``, or in a session of its own as a stream's batches are.  ``read_rows`` does so.
    """
    placed = lines.withColumn("_place", F.monotonically_increasing_id())
    splits = _split_table(placed)
    records = line_records(placed, splits)
    if not splits.where("_open").isEmpty():
        records = records.unionByName(open_records(placed, splits))
    rows = records.where("row > 0").withColumn("cells", split_cells(F.col("value")))
    rows = rows.withColumn("plain_header", F.size(F.array_distinct("header")) == F.size("header"))
    matched = F.least(F.size("header"), F.size("cells"))
    rows = rows.withColumns({
        "keys": F.slice("header", F.lit(1), matched),
        "cells": F.slice("cells", F.lit(1), matched),
    })
    rows = rows.withColumn(
        "members",
        F.to_json(
            F.when(F.col("plain_header"), F.map_from_arrays("keys", "cells"))
            .otherwise(_last_of_name(F.col("keys"), F.col("cells")))
        ),
    )
    text = F.concat_ws(
        ",",
        F.when(~F.array_contains("keys", "file"), F.concat(F.lit('"file":'), _json_text(F.col("_name")))),
        F.when(~F.array_contains("keys", "row"), F.concat(F.lit('"row":'), F.col("row").cast("string"))),
        F.when(F.col("members") != "{}", _inside(F.col("members"))),
    )
    return rows.select(
        F.col("_name").alias("file"), "row", F.concat(F.lit("{"), text, F.lit("}")).alias("value")
    )


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, row, value`` of all data rows of the CSV files of a folder, or of the files named.

    They are written to the scratch folder and read from there, so that the files are read as they are now and no session
    setting stays behind.
    """
    with same_splits(spark):
        return _kept(envelopes(read_lines(spark, path)), "csv-rows")
