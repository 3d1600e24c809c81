"""CSV intake by row: bounded batches, stops inside a file, resumes five rows before."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlake.streaming.intake import read_bronze
from wardlake.streaming.row_intake import RowIntake, Slice, slices


def test_slices():
    files = [("a", 0, 5), ("b", 0, 0), ("c", 2, 9)]
    assert slices(files, 4) == [
        [Slice("a", 0, 4, False)], [Slice("a", 4, 5, True), Slice("b", 0, 0, True), Slice("c", 2, 5, False)], [Slice("c", 5, 9, True)],
    ]
    assert slices(files, 100) == [[Slice("a", 0, 5, True), Slice("b", 0, 0, True), Slice("c", 2, 9, True)]]
    assert slices([], 4) == []


@pytest.fixture()
def source(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "b.csv").write_text("k,v\n" + "".join(f'{i},"b\n{i}"\n' for i in range(1, 31)))
    (folder / "c.csv").write_text("k\n" + "".join(f"{i}\n" for i in range(1, 6)))
    (folder / "empty.csv").write_text("k\n")
    return folder


def landed(spark, tmp_path):
    rows = read_bronze(spark, f"{tmp_path}/bronze").select(
        F.try_variant_get("payload", "$.file", "string").alias("file"), F.try_variant_get("payload", "$.row", "int").alias("row"),
    ).collect()
    return Counter(map(tuple, rows))


def test_resume_inside_a_file(spark, tmp_path, source):
    def reader(n=12):
        return RowIntake(spark, str(source), f"{tmp_path}/bronze", f"{tmp_path}/state", rows_per_batch=n)

    assert reader().run(batches=1) == 1
    assert landed(spark, tmp_path) == Counter({("b.csv", i): 1 for i in range(1, 13)})
    (source / "a.csv").write_text("k\n7\n")
    assert [(p.rsplit("/", 1)[1], row) for p, _, row in reader().pending()] == [("b.csv", 12), ("a.csv", 0), ("c.csv", 0), ("empty.csv", 0)]
    # Rows 8 to 30 of b, 1 of a, 5 of c: 29 in batches of 12.
    assert reader().run() == 3
    want = Counter({("b.csv", i): 1 for i in range(1, 31)}) + Counter({("b.csv", i): 1 for i in range(8, 13)})
    want += Counter({("a.csv", 1): 1}) + Counter({("c.csv", i): 1 for i in range(1, 6)})
    assert landed(spark, tmp_path) == want
    assert reader().pending() == [] and reader().run() == 0


def test_a_batch_that_was_landed_and_not_noted_is_landed_anew(spark, tmp_path, source, monkeypatch):
    reader = RowIntake(spark, str(source), f"{tmp_path}/bronze", f"{tmp_path}/state", rows_per_batch=20, window_bytes=1)
    reader.run(batches=1)
    reader.state_path, kept = f"{tmp_path}/lost", reader.state_path
    reader._land(*_second_batch(spark, source), 1)
    reader.state_path = kept
    assert reader.run() == 3
    want = Counter({("b.csv", i): 1 for i in range(1, 31)}) + Counter({("b.csv", i): 1 for i in range(16, 21)})
    assert landed(spark, tmp_path) == want + Counter({("c.csv", i): 1 for i in range(1, 6)})


def _second_batch(spark, source):
    from wardlake.sources.csv_rows import read_rows

    return read_rows(spark, [str(source / "b.csv")]), [Slice("b.csv", 20, 30, True)]
