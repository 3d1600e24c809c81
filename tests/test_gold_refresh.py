"""Gold and its roll-ups kept by changes, against gold made from scratch."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardlake.operators import rollups
from wardlake.operators.enrich import enrich_visits
from wardlake.operators.upsert import changes_by, feed_applied, latest_by_key
from wardlake.plans.gold_refresh import GoldTables
from wardlake.schemas import DOCTORS, SILVER_VISITS

DEPARTMENTS = ["Cardiology", "General Practice", "A/B: c%d", None]


def some_visits(spark, seed, n, ids, department=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            f"P{i}", datetime(2024, rng.randint(1, 3), 1, rng.randint(0, 23)), "A", "X", "male", rng.choice([None, 5, 30, 70]), None,
            department or rng.choice(DEPARTMENTS), rng.choice([True, False, None]), rng.choice([None, 1, 9]), rng.choice([None, 3, 20, 90]),
            rng.choice([True, False, None]), rng.choice(["D1", "D2", "D3", "D4", None]), "f", i, f"v{rng.choice(ids)}", datetime(2024, 5, seed, 0, i % 60), None,
        ))
    return spark.createDataFrame(rows, SILVER_VISITS)


def some_doctors(spark, *rows):
    return spark.createDataFrame([(i, "Jo", "Li", d, "s", "U", y) for i, d, y in rows], DOCTORS)


def bag(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def check(tables, visits, doctors):
    gold = enrich_visits(visits, doctors)
    assert bag(tables.gold()) == bag(gold)
    for name in rollups.ROLLUPS:
        assert bag(tables.rollup(name)) == bag(rollups.rollup(gold, name)), name


FIRST = [("D1", "Cardiology", 3), ("D2", "General Practice", 12), ("D3", None, 20)]
# D1 moves, D2 stays, D3 is there twice, D4 is new.
SECOND = [("D1", "A/B: c%d", 3), ("D2", "General Practice", 12), ("D3", None, 20), ("D3", "Cardiology", 21), ("D4", "Cardiology", None)]


def test_refreshes_equal_gold_from_scratch(spark, tmp_path):
    visits = latest_by_key(some_visits(spark, 1, 40, range(30)))
    tables = GoldTables(spark, str(tmp_path))
    doctors = some_doctors(spark, *FIRST)
    tables.start(visits, doctors)
    check(tables, visits, doctors)
    # Changed visits and changed doctors; doctors alone; visits alone; nothing.
    for version, (batch, doctors) in enumerate([
        (some_visits(spark, 2, 15, range(20, 45)), some_doctors(spark, *SECOND)), (visits.limit(0), some_doctors(spark, *FIRST[:2])),
        (some_visits(spark, 3, 10, range(40)), some_doctors(spark, *FIRST[:2])), (visits.limit(0), some_doctors(spark, *FIRST[:2])),
    ], 1):
        feed = changes_by(visits, batch)
        tables.apply(feed, doctors, version)
        visits = spark.createDataFrame(feed_applied(visits, feed).collect(), SILVER_VISITS)
        check(tables, visits, doctors)
        tables.apply(feed, doctors, version)
    assert tables.version() == 4
    check(tables, visits, doctors)
    assert {p.name for p in tmp_path.iterdir()} == {"gold", "current", "staged", "sums-4", "doctors-4"}
    with pytest.raises(ValueError):
        tables.apply(feed, doctors, 9)


def test_other_folders_are_neither_read_nor_written(spark, tmp_path):
    visits = spark.createDataFrame(
        some_visits(spark, 1, 20, [1], "Cardiology").withColumn("visit_id", F.concat(F.lit("c"), "source_row")).collect()
        + some_visits(spark, 2, 20, [1], "Neurology").withColumn("visit_id", F.concat(F.lit("n"), "source_row")).collect(), SILVER_VISITS)
    doctors = some_doctors(spark, ("D1", "Cardiology", 3), ("D2", "Neurology", 3), ("D3", "Orthopedics", 3), ("D4", "Physiotherapy", 3))
    tables = GoldTables(spark, str(tmp_path))
    tables.start(visits, doctors)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("gold/*/*/*.parquet")}
    changed = visits.where("visit_id = 'c3'").withColumn("bronze_timestamp", F.lit(datetime(2024, 6, 1))).withColumn("doctor_id", F.lit("D1"))
    feed = changes_by(visits, changed)
    # What is far from the change cannot even be read.
    for path in files:
        if "referral_group=dept_neurology" in str(path):
            path.write_bytes(b"unreadable")
    tables.apply(feed, doctors, 1)
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("gold/*/*/*.parquet")}
    assert all(p in after and "dept_neurology" in str(p) for p in files if "referral_group=dept_neurology" in str(p))
    rewritten = {p.parent for p in files if p not in after}
    assert 1 <= len(rewritten) <= 2 and all("referral_group=dept_cardiology" in str(p) for p in rewritten)


@pytest.mark.parametrize("at", ["_publish", "rollups"])
def test_a_refresh_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch, at):
    visits = latest_by_key(some_visits(spark, 1, 30, range(20)))
    tables = GoldTables(spark, str(tmp_path))
    tables.start(visits, some_doctors(spark, *FIRST))
    feed = changes_by(visits, some_visits(spark, 2, 12, range(30)))

    def crash(*_args, **_kwargs):
        raise RuntimeError("gone")

    with monkeypatch.context() as patch:
        if at == "rollups":
            patch.setattr(rollups, "added", crash)
        else:
            real, calls = tables._publish, []
            patch.setattr(tables, "_publish", lambda: crash() if calls else calls.append(1) or real())
        with pytest.raises(RuntimeError):
            tables.apply(feed, some_doctors(spark, *SECOND), 1)
    again = GoldTables(spark, str(tmp_path))
    again.apply(feed, some_doctors(spark, *SECOND), 1)
    check(again, feed_applied(visits, feed), some_doctors(spark, *SECOND))


@pytest.mark.parametrize("name", list(rollups.ROLLUPS))
def test_sums_give_the_same_numbers(spark, name):
    gold = enrich_visits(some_visits(spark, 7, 200, range(1000)), some_doctors(spark, *SECOND))
    assert bag(rollups.finished(rollups.partials(gold, name), name)) == bag(rollups.rollup(gold, name))
    none = rollups.added(rollups.partials(gold, name), rollups.partials(gold, name, -1), name)
    assert none.count() == 0


def test_visits_that_changed_are_not_broadcast(spark, tmp_path, monkeypatch):
    visits = latest_by_key(some_visits(spark, 1, 40, range(30)))
    tables = GoldTables(spark, str(tmp_path))
    tables.start(visits, some_doctors(spark, *FIRST))
    feed, plans, write = changes_by(visits, some_visits(spark, 2, 15, range(20, 45))), [], tables._write

    def noted(df, *parts, **kinds):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *parts, **kinds)

    monkeypatch.setattr(tables, "_write", noted)
    tables.apply(feed, some_doctors(spark, *SECOND), 1)
    written = "\n".join(plans)
    assert written.count("SortMergeJoin [visit_id") == 3 and "BroadcastHashJoin [visit_id" not in written
    check(tables, feed_applied(visits, feed), some_doctors(spark, *SECOND))
