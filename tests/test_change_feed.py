"""The change feed of the upsert, in batch and stream form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators.upsert import changes_by, feed_applied, latest_by_key
from wardlake.streaming.current_state import CurrentVisits

VISIT = "visit_id string, age int, bronze_timestamp timestamp, source_file string, source_row int, silver_timestamp timestamp"


def visits(spark, seed, n):
    rng = random.Random(seed)
    rows = [
        (f"v{rng.randint(1, 12)}", rng.choice([1, 2, None]), f"2024-01-01 00:0{rng.randint(0, 5)}:00", "f", rng.choice([1, None]), f"2024-02-0{seed} 00:00:00")
        for _ in range(n)
    ]
    frame = spark.createDataFrame(rows, "visit_id string, age int, b string, source_file string, source_row int, s string")
    return frame.select("visit_id", "age", F.col("b").cast("timestamp").alias("bronze_timestamp"), "source_file", "source_row", F.col("s").cast("timestamp").alias("silver_timestamp"))


def state(df):
    return sorted(map(tuple, df.drop("silver_timestamp").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_feed_takes_the_old_state_to_the_new(spark, seed):
    first, second = visits(spark, seed, 15), visits(spark, seed + 4, 15)
    before, after = latest_by_key(first), latest_by_key(first.unionByName(second))
    feed = changes_by(before, second)
    assert state(feed_applied(before, feed)) == state(after)
    old, new = {r[0]: r for r in state(before)}, {r[0]: r for r in state(after)}
    want = [("insert", *r) for k, r in new.items() if k not in old]
    want += [("update_preimage", *old[k]) for k, r in new.items() if k in old and old[k] != r]
    want += [("update_postimage", *r) for k, r in new.items() if k in old and old[k] != r]
    assert state(feed) == sorted(want, key=str)


def test_the_same_rows_again_change_nothing(spark):
    rows = visits(spark, 5, 20)
    assert changes_by(latest_by_key(rows), rows.withColumn("silver_timestamp", F.current_timestamp())).count() == 0
    assert changes_by(latest_by_key(rows), rows.limit(0)).count() == 0
    assert changes_by(rows.limit(0), rows).where("change <> 'insert'").count() == 0


def test_the_table_keeps_a_feed_per_batch(spark, tmp_path):
    from tests.test_streaming import clean, visit_rows

    rows = visit_rows(90, seed=4)
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2)
    states = [latest_by_key(clean(spark, rows[:0]))]
    for i, part in enumerate((rows[:50], rows[50:70], rows[70:])):
        table.apply(clean(spark, part), i, run="s")
        states.append(latest_by_key(clean(spark, rows[: (50, 70, 90)[i]])))
    # A batch that is in the table already leaves the table and its feed as they are.
    table.apply(clean(spark, rows[70:]), 2, run="s")
    for i in range(3):
        assert state(feed_applied(states[i], table.feed(i, "s"))) == state(states[i + 1])
    assert table.feed(2, "s").where("change = 'update_preimage'").count() > 0


def test_small_batches_leave_one_file_a_partition(spark, tmp_path):
    from tests.test_streaming import clean

    def one(i, when):
        return json.dumps({"patient_id": f"P{i}", "patient_admission_date": when}), f"2024-03-01T00:{i % 60:02}:00Z"

    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=1, rows_per_task=10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.apply(clean(spark, [one(i, "unknown") for i in range(60)]), 0)
        for batch in range(1, 4):
            table.apply(clean(spark, [one(batch, "2024-01-01"), one(100 + batch, "unknown")]), batch)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {p: len(list(p.glob("*/*.parquet"))) for p in tmp_path.glob("visits/admission_period=*")}
    by_name = {p.name.split("=")[1]: n for p, n in files.items()}
    assert by_name["2024-01"] == 1 and 2 <= by_name["undated"] <= 7
    assert table.read().count() == 66
