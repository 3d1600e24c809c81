"""CSV files to JSON rows, and JSON lines."""

import csv
import io
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wardlake.operators.patients import clean_visits
from wardlake.sources import csv_rows
from wardlake.sources.envelopes import (
    accepted_lines, parse_lines, rejected_lines, to_bronze,
)
from wardlake.sources.tables import read_jdbc_table

FILES = {
    "a.csv": "Patient ID, Last Name ,Age\nP1,\"Smith, \"\"Jo\"\"\",41\nP2,Lee\nP3,Ray,7,surplus\n\nP4,\"\",\n",
    "B.TXT": "row,file,note\r\n9,other.csv,\"tail\"x\r\n,,\"a\"\"b\"\r\n",
    "c.csv": "k,k,Z\n1,2,3\n4\n",
    "empty.csv": "only_header\n",
    "skipped.json": "{}\n",
}


def expected(name, content):
    """What the csv module makes of a file."""
    header, *rows = csv.reader(io.StringIO(content))
    header = [h.strip().lower().replace(" ", "_") for h in header]
    return [{"file": name, "row": i, **dict(zip(header, r))} for i, r in enumerate(rows, 1)]


@pytest.fixture()
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content.encode())
    return tmp_path


def test_rows_of_mixed_files(spark, folder):
    rows = csv_rows.read_rows(spark, str(folder)).collect()
    got = {(r.file, r.row): json.loads(r.value) for r in rows}
    want = {
        (name, i): row
        for name, content in FILES.items() if name != "skipped.json"
        for i, row in enumerate(expected(name, content), 1)
    }
    assert got == want
    assert [r.file for r in csv_rows.list_files(spark, str(folder)).collect()] == ["B.TXT", "a.csv", "c.csv", "empty.csv"]


def test_row_numbers_of_a_file_split_over_tasks(spark, tmp_path):
    lines = ["id,text"] + [f"{i},{'x' * (i * 7 % 90)}" for i in range(3000)]
    (tmp_path / "long.csv").write_text("\n".join(lines))
    (tmp_path / "short.csv").write_text("id,text\n5,a\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert csv_rows.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        rows = csv_rows.read_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    numbered = {r.row: json.loads(r.value)["id"] for r in rows if r.file == "long.csv"}
    assert numbered == {i + 1: str(i) for i in range(3000)}
    assert len(rows) == 3001


def test_cells_equal_the_csv_module(spark):
    lines = ["a,b", ",", "", "a,", ",b", '"a,b",c', '"a""b"', '""', '"",""', 'a"b,c', '"a"b,c', ' "a",b', '"x" ,y',
             '"""",z', "ä,ß", "a;b", '"' + "x" * 20000 + '",end', '"' + 'q""' * 3000 + '",end']
    frame = spark.createDataFrame(list(enumerate(lines)), "i INT, line STRING")
    got = {r.i: r.cells for r in frame.select("i", csv_rows.split_cells(F.col("line")).alias("cells")).collect()}
    for i, line in enumerate(lines):
        assert got[i] == next(csv.reader([line])), line[:40]


def test_random_cells_equal_the_csv_module(spark):
    rng = random.Random(11)
    lines = {"".join(rng.choice('ab,," \t\'') for _ in range(rng.randint(0, 12))) for _ in range(4000)}
    # A quote left open runs on into the next line: not for a reader of single lines.
    closed = [line for line in lines if len(list(csv.reader([line, "z"]))) == 2]
    assert len(closed) > 1500
    frame = spark.createDataFrame(list(enumerate(closed)), "i INT, line STRING")
    got = frame.select("i", csv_rows.split_cells(F.col("line")).alias("cells")).collect()
    wrong = [(closed[r.i], r.cells) for r in got if r.cells != next(csv.reader([closed[r.i]]))]
    assert wrong == []


def whole_file_cases():
    """Files with line feeds, carriage returns and both inside and after cells, quotes in odd places, and open ends."""
    rng = random.Random(12)
    files = {
        "m.csv": 'Patient ID,Note,Empty\nP1,"two\nlines",\nP2,x,""\n"P""3","a,\n\n""b""\n",y\n\nP4\n',
        "n.csv": 'Other, Note \nP3,"say ""hi"""\n',
        "h.csv": '"a\r\nb",c\r\n1,2\r\n\r\n"x\ry\r\n",3\r\n',
        "o.csv": 'a,b\n1,"open\nto the, end\n',
        "p.csv": 'a,b\n1,"open\r\nto the end',
        "q.csv": 'a,b\n1,"',
        "big.csv": "a,b\n" + "".join(f'{i},"x{chr(10) * (i % 3)}{"y" * (i % 50)}"\n' for i in range(400)) + '1,"' + "long\n" * 300 + '"\nlast,1\n',
    }
    for k in range(60):
        cells = [["".join(rng.choice('ab,"\n\r x') for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 4))] for _ in range(12)]
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["k1", "k2", "k3"], *cells])
        files[f"r{k}.csv"] = text.getvalue()
    while len(files) < 200:
        loose = "k1,k2\n" + "".join(rng.choice(['a', ',', '"', '""', '\n', '\r\n', ' ', ',"']) for _ in range(rng.randint(1, 40)))
        try:
            list(csv.reader(io.StringIO(loose)))
        except csv.Error:  # a carriage return in the middle of an unquoted cell
            continue
        files[f"s{len(files)}.csv"] = loose
    return files


@pytest.mark.parametrize("split_bytes", [None, 37])
def test_whole_files_equal_the_csv_module(spark, tmp_path, split_bytes):
    files = whole_file_cases()
    for name, content in files.items():
        (tmp_path / name).write_text(content, newline="")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        # Few files, each cut into several splits.
        for name in [n for n in files if n not in ("h.csv", "o.csv", "p.csv", "m.csv", "r3.csv", "s80.csv", "s81.csv", "s82.csv")]:
            del files[name]
            (tmp_path / name).unlink()
    try:
        rows = csv_rows.read_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r.file, r.row): json.loads(r.value) for r in rows}
    assert len(got) == len(rows)
    want = {(name, i): row for name, content in files.items() for i, row in enumerate(expected(name, content), 1)}
    wrong = [(k, got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)]
    assert wrong == []


def test_reading_leaves_no_setting_behind(spark, folder):
    before = dict(spark.conf.getAll)
    csv_rows.read_rows(spark, str(folder))
    after = dict(spark.conf.getAll)
    assert {k: v for k, v in after.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}


def test_files_that_spark_would_skip_are_named(spark, tmp_path):
    for name in ("a.csv", "_x.Csv", ".y.TXT", "_z.json"):
        (tmp_path / name).write_text("k\n1\n")
    with pytest.raises(ValueError, match="[.]y[.]TXT, _x[.]Csv$"):
        csv_rows.read_lines(spark, str(tmp_path))


def test_strict_json_lines_equal_the_json_module(spark):
    rng = random.Random(1)
    base = ['{"a": 1}', '{"a":1} x', '{"a":1,"a":2}', '{"a": NaN}', "[1,2]", "1],[2", '1},{"v":2', "],[", "1,2", '{"a":"]"}',
            '  {"a":1}  ', '"x"', "null", "tru", '{"a":[1,{"b":"}"}]}', "-1e5", "01", '{"a":1,}', "\t", "[]", '{"a":1}]', "1]"]
    lines = base + ["".join(rng.choice('{}[],:"ab12 -.]}') for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    for line in base * 40:
        at = rng.randrange(len(line))
        lines.append(line[:at] + rng.choice('{}[],:"1 ') + line[at + rng.randint(0, 1) :])

    def decoded(line):
        def refuse(_):
            raise ValueError

        try:
            return json.loads(line, parse_constant=refuse)
        except ValueError:
            return "bad"

    rows = parse_lines(spark.createDataFrame([(x,) for x in lines], "value STRING")).select("value", F.to_json("payload").alias("p"), F.col("payload").isNull().alias("bad"))
    for r in rows.collect():
        want = decoded(r.value)
        assert r.bad == (want == "bad") and (r.bad or json.loads(r.p) == want), r.value


def test_json_lines(spark):
    lines = spark.createDataFrame(
        [('{"patient_id": "P1"}',), ("",), ('{"patient_id": ',), ("7",), (" ",)], "value STRING"
    )
    seen = Observation()
    bronze = to_bronze(accepted_lines(lines, observation=seen), arrived=F.lit(datetime(2024, 1, 1)))
    ids = [r.patient_id for r in clean_visits(bronze).collect()]
    assert sorted(ids, key=str) == [None, "P1"] or sorted(ids, key=str) == ["P1", None]
    assert seen.get == {"lines": 4, "rejected": 2}
    assert {r.value for r in rejected_lines(lines).collect()} == {'{"patient_id": ', " "}
    assert parse_lines(lines).count() == 4



def test_jdbc_ranges_need_all_their_parts(spark):
    with pytest.raises(ValueError, match="bounds"):
        read_jdbc_table(spark, "jdbc:none", "doctors", split_column="id")
