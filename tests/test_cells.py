"""Single cells: what each text becomes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardlake.functions import cells
from wardlake.functions.bands import AGE_BANDS, EXPERIENCE_BANDS, WAIT_BANDS, band
from wardlake.functions.times import ADMISSION_PATTERNS, arrival_stamp, parse_admission_time


def apply(spark, function, values, kind="string"):
    """The function's result for every value, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i INT, x {kind}")
    found = rows.select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(found, key=lambda r: r.i)]


def check(spark, function, cases, kind="string"):
    assert dict(zip(cases, apply(spark, function, list(cases), kind))) == cases


def test_markers(spark):
    check(spark, cells.null_if_marker, {
        "N/A": None, "Unknown": None, "None": None, "": None, " ": None,
        "n/a": "n/a", "unknown": "unknown", "  ": "  ", "x": "x", None: None,
    })


def test_gender(spark):
    check(spark, cells.gender_label, {
        "Male": "male", "m": "male", "MALE": "male", "f": "female", "Female": "female",
        "x": None, " male": None, "": None, None: None,
    })


def test_yes_no(spark):
    check(spark, cells.yes_no, {
        "Y": True, "yes": True, "yellow": True, "TRUE": True, "1": True,
        "N": False, "nope": False, "false": False, "0": False,
        "maybe": None, "1.0": None, "10": None, "": None, None: None,
    })


def test_text(spark):
    check(spark, cells.initial, {"ab": "A", " ab": " ", "q": "Q", "": "", None: None})
    check(spark, cells.title_case, {
        "SMITH": "Smith", "O'NEIL smith-JONES": "O'neil Smith-jones", " a  b ": " A  B ", None: None,
    })
    check(spark, cells.trimmed_title, {" general practice ": "General Practice", None: None})


def test_whole_number(spark):
    check(spark, cells.whole_number, {
        "41": 41, "41.7": 41, "-3.9": -3, " 12 ": 12, "1e2": 100, "abc": None, "": None,
        "1e10": None, "NaN": None, "Infinity": None, None: None,
    })


def test_admission_time(spark):
    check(spark, parse_admission_time, {
        "2024-01-15 08:30:00": datetime(2024, 1, 15, 8, 30),
        "15-01-2024 08:30": datetime(2024, 1, 15, 8, 30),
        "15-01-2024 08:30:05": datetime(2024, 1, 15, 8, 30, 5),
        "15/01/2024 08:30": datetime(2024, 1, 15, 8, 30),
        "15/01/2024 08:30:05": datetime(2024, 1, 15, 8, 30, 5),
        "03/14/2024 10:00:00": datetime(2024, 3, 14, 10),
        "03/04/2024 10:00:00": datetime(2024, 4, 3, 10),
        "15-01-2024": datetime(2024, 1, 15),
        "2024-01-15": datetime(2024, 1, 15),
        "15/01/2024": datetime(2024, 1, 15),
        "03/14/2024": datetime(2024, 3, 14),
        "03/04/2024": datetime(2024, 4, 3),
        "03/14/2024 10:00": None,
        "2024-01-15 08:30": None,
        "2024-01-15T08:30:00": None,
        "5-1-2024 8:30": None,
        " 2024-01-15": None,
        "31-02-2024": None,
        "not-a-date": None,
        "": None,
        None: None,
    })


def test_admission_time_by_shape_equals_trying_all_patterns(spark):
    stems = ["2024-02-29", "29-02-2024", "29/02/2024", "02/29/2024", "+12024-01-01", "01-02-+12024",
             "01/02/+12024", "99-99-9999", "1-1-2024", "2024-1-1", "2024/01/02", "ab-cd-efgh"]
    times = ["", " 08:30", " 08:30:59", " 24:00:00", " 8:3", "T08:30:00", " 08:30:00.5", " "]
    values = [s + t for s in stems for t in times]
    frame = spark.createDataFrame(list(enumerate(values)), "i INT, x STRING")
    every = F.coalesce(*[F.try_to_timestamp("x", F.lit(p)) for p in ADMISSION_PATTERNS])
    different = frame.where(~parse_admission_time(F.col("x")).eqNullSafe(every))
    assert different.collect() == []


def test_arrival_stamp_reads_back(spark):
    moments = [datetime(2024, 1, 15, 9), datetime(2024, 1, 15, 9, 0, 0, 123400)]
    stamps = apply(spark, arrival_stamp, moments, "timestamp")
    assert stamps == ["2024-01-15T09:00:00+00:00", "2024-01-15T09:00:00.123400+00:00"]
    assert apply(spark, F.try_to_timestamp, stamps) == moments


@pytest.mark.parametrize("bands, cases", [
    (AGE_BANDS, {-1: "0-17", 17: "0-17", 18: "18-39", 39: "18-39", 40: "40-64", 64: "40-64",
                 65: "65+", 130: "65+", None: None}),
    (WAIT_BANDS, {-5: "00-15", 0: "00-15", 15: "00-15", 16: "16-30", 30: "16-30", 31: "31-45",
                  45: "31-45", 46: "46+", None: None}),
    (EXPERIENCE_BANDS, {-1: "0-10", 10: "0-10", 11: "11-15", 15: "11-15", 16: "16+", None: None}),
])
def test_bands(spark, bands, cases):
    check(spark, lambda c: band(c, bands), cases, "int")


def test_short_cut_equals_the_whole_list(spark):
    import random

    from wardlake.functions.times import _first_parse

    rng = random.Random(3)

    def text():
        sep = rng.choice("-/")
        day, month, year = f"{rng.randint(1, 31):02d}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 2030):04d}"
        out = sep.join(rng.choice([(year, month, day), (day, month, year), (month, day, year)]))
        if rng.random() < 0.5:
            out += f" {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}" + rng.choice(["", ":07"])
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(out))
            out = out[:at] + rng.choice("-+/ :01") + out[at + rng.randint(0, 1) :]
        return out

    texts = ["-2024-01-15", "15-01--2024", "15/01/-2024", "+2024-01-15", *[text() for _ in range(25_000)]]
    frame = spark.createDataFrame([(t,) for t in texts], "t STRING")
    cell = F.col("t")
    other = frame.where(~parse_admission_time(cell).eqNullSafe(_first_parse(cell, ADMISSION_PATTERNS)))
    assert other.count() == 0
