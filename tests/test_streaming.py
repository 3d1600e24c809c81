"""Streams give the state a batch gives, however they are cut, stopped or run again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators.upsert import latest_by_key
from wardlake.plans.lake import current_visits
from wardlake.session import scratch_dir
from wardlake.sources.envelopes import parse_lines
from wardlake.sources.tables import stream_table
from wardlake.streaming import intake
from wardlake.streaming.current_state import CurrentVisits, visits_upsert

HEADER = "Patient ID,Patient Admission Date,Patient Age,Doctor ID\n"


def write_csv(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(f"{r}\n" for r in rows))


def payloads(spark, bronze):
    text = F.to_json(F.col("payload"))
    return sorted((json.loads(r.p) for r in intake.read_bronze(spark, bronze).select(text.alias("p")).collect()), key=str)


def test_csv_intake_resumes_and_starts_over(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path)
    bronze = f"{root}/bronze"

    def run(checkpoint, **options):
        stream = intake.csv_to_bronze(spark, str(source), bronze, f"{root}/{checkpoint}", **options)
        assert intake.run_for(stream)
        return payloads(spark, bronze)

    write_csv(source, "a.csv", "P1,2024-01-01,30,DOC-1", "P2,2024-01-02,31,DOC-2")
    assert [(p["file"], p["row"], p["patient_id"]) for p in run("one")] == [("a.csv", 1, "P1"), ("a.csv", 2, "P2")]
    write_csv(source, "b.csv", "P3,2024-01-03,32,DOC-1")
    write_csv(source, "c.CSV", "P4,2024-01-03,32,DOC-1")
    (source / "d.log").write_text("no csv")
    assert len(run("one", files_per_batch=1)) == 4
    assert len(run("one")) == 4
    assert len(run("two")) == 8
    stamps = {r.timestamp_bronze for r in intake.read_bronze(spark, bronze).collect()}
    assert all(s.endswith("+00:00") for s in stamps)


def test_a_batch_run_again_lands_once(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "metadata").write_text('{"id":"run-1"}')
    land = intake._land_json(f"{tmp_path}/bronze", f"{tmp_path}/one")
    batch = parse_lines(spark.createDataFrame([('{"a": 1}',), ("bad",)], "value STRING"))
    for _ in range(2):
        land(batch, 0)
    assert payloads(spark, f"{tmp_path}/bronze") == [{"a": 1}]
    assert spark.read.parquet(f"{tmp_path}/bronze_rejects").count() == 1


def test_json_lines_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    stream = intake.json_lines_to_bronze(
        spark, f"{tmp_path}/in", f"{tmp_path}/bronze", f"{tmp_path}/check", files_per_batch=1
    )
    assert intake.run_for(stream)
    assert payloads(spark, f"{tmp_path}/bronze") == [{"a": 1}, {"a": 2}]
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/bronze_rejects").collect()] == ['{"a": ']
    counts = [p.observedMetrics["lines"] for p in stream.recentProgress if "lines" in p.observedMetrics]
    assert [(c.lines, c.rejected) for c in counts] == [(3, 1)]


def test_runs_with_equal_folder_names_keep_apart(spark, tmp_path):
    bronze = f"{tmp_path}/bronze"

    def run(month):
        stream = intake.csv_to_bronze(spark, f"{tmp_path}/{month}", bronze, f"{tmp_path}/checkpoints/{month}/visits")
        assert intake.run_for(stream)
        return len(payloads(spark, bronze))

    write_csv(tmp_path / "jan", "a.csv", "P1,2024-01-01,30,DOC-1", "P2,2024-01-02,31,DOC-2")
    write_csv(tmp_path / "feb", "a.csv", "P3,2024-02-01,30,DOC-1")
    assert run("jan") == 2
    assert run("feb") == 3
    # A checkpoint made anew at an old path reads all again and deletes nothing.
    import shutil
    shutil.rmtree(tmp_path / "checkpoints/jan")
    assert run("jan") == 5


def test_quarantined_rows_of_two_streams_stay(spark, tmp_path):
    rows = [(json.dumps({"patient_id": f"P{i}", "patient_admission_date": "2024-01-01", "row": i}), "") for i in range(4)]
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=1)
    for name, part in (("jan", rows[:2]), ("feb", rows[2:])):
        bronze_of(spark, part).write.parquet(f"{tmp_path}/{name}/bronze")
        visits_upsert(stream_table(spark, f"{tmp_path}/{name}/bronze"), table, f"{tmp_path}/{name}/visits").awaitTermination()
    assert {r.patient_id for r in spark.read.parquet(table.quarantine).collect()} == {"P0", "P1", "P2", "P3"}
    assert table.read().count() == 0


def test_a_large_partition_is_shared_by_several_tasks(spark, tmp_path):
    def one(i):
        when = "2024-01-01" if i % 10 == 0 else "unknown"
        return json.dumps({"patient_id": f"P{i}", "patient_admission_date": when}), "2024-03-01T00:00:00Z"

    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=1, rows_per_task=20)
    # Small shares would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in range(2):
            table.apply(clean(spark, [one(i) for i in range(100 * part, 100 * part + 100)]), part)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert table.read().count() == 200
    undated = list(tmp_path.glob("visits/admission_period=undated/*/*.parquet"))
    assert len(undated) > 1


def visit_rows(n, seed=1):
    """Many versions of few visits, some undated, some without patient, some without time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = rng.randint(1, 3)
        month = rng.choice(["01", "02", "xx"])
        payload = {
            "patient_id": f"P{rng.randint(1, 5)}" if rng.random() < 0.9 else "N/A",
            "patient_admission_date": f"0{day}-{month}-2024 10:00", "patient_age": str(i),
            "file": "f.csv", "row": i + 1,
        }
        arrived = f"2024-03-01T00:{rng.randint(10, 40)}:00+00:00" if rng.random() < 0.95 else ""
        rows.append((json.dumps(payload), arrived))
    return rows


def bronze_of(spark, rows):
    frame = spark.createDataFrame(rows, "value STRING, timestamp_bronze STRING")
    return frame.select(F.parse_json("value").alias("payload"), "timestamp_bronze")


def state(df):
    return sorted(map(tuple, df.drop("silver_timestamp").collect()), key=str)


@pytest.mark.parametrize("parts, spread", [(1, 1), (4, 3)])
def test_stream_equals_batch(spark, tmp_path, parts, spread):
    rows = visit_rows(120)
    want = state(current_visits(bronze_of(spark, rows)))
    random.Random(2).shuffle(rows)
    for i in range(parts):
        bronze_of(spark, rows[i::parts]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bronze")
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2, spread=spread)
    stream = visits_upsert(
        stream_table(spark, f"{tmp_path}/bronze", files_per_batch=1), table, f"{tmp_path}/check"
    )
    stream.awaitTermination()
    metrics = [p.observedMetrics["visit_rules"] for p in stream.recentProgress if "visit_rules" in p.observedMetrics]
    assert sum(m.rows for m in metrics) == 120
    assert state(table.read()) == want
    quarantined = spark.read.parquet(table.quarantine).count()
    assert quarantined == sum(1 for p, t in rows if not t and '"N/A"' not in p)


def clean(spark, rows):
    from wardlake.operators.patients import clean_visits
    from wardlake.operators.quality import VISIT_RULES, expect
    from wardlake.schemas import SILVER_VISITS, enforce_schema

    return expect(enforce_schema(clean_visits(bronze_of(spark, rows)), SILVER_VISITS), VISIT_RULES)


class Crash(Exception):
    pass


@pytest.mark.parametrize("at", ["merge", "staged", "half published", "published"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, at):
    rows = visit_rows(90, seed=3)
    first, second = rows[:50], rows[50:]
    want = state(latest_by_key(clean(spark, rows)))
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2)
    table.apply(clean(spark, first), 0)

    def crash(*_args, **_kwargs):
        raise Crash

    def half_published():
        # Some partitions are gone and not yet replaced.
        import shutil
        shutil.rmtree(f"{tmp_path}/visits/admission_period=2024-01")
        raise Crash

    def published():
        staged = spark.read.parquet(table.staging)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "admission_period", "key_slice").parquet(table.path)
        raise Crash

    with monkeypatch.context() as patch:
        if at == "merge":
            patch.setattr(table, "_merge", crash)
        elif at == "staged":
            patch.setattr(table, "_publish", crash)
        else:
            patch.setattr(table, "_publish", half_published if at == "half published" else published)
        with pytest.raises(Crash):
            table.apply(clean(spark, second), 1)
    table.apply(clean(spark, second), 1)
    assert state(table.read()) == want
    table.apply(clean(spark, second), 1)
    assert state(table.read()) == want


def test_untouched_partitions_are_not_rewritten(spark, tmp_path):
    def one(month):
        return [(json.dumps({"patient_id": "P1", "patient_admission_date": f"2024-{month}-01"}), "2024-03-01T00:00:00Z")]

    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=1)
    table.apply(clean(spark, one("01") + one("02")), 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("visits/*/*/*.parquet")}
    table.apply(clean(spark, one("02")), 1)
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("visits/*/*/*.parquet")}
    january = {p for p in before if "2024-01" in str(p)}
    assert january and all(after[p] == before[p] for p in january)
    assert len(after) == 2 and table.read().count() == 2


def test_current_scan_is_pruned_to_touched_partitions(spark, tmp_path, capsys):
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2)
    table.apply(clean(spark, visit_rows(60)), 0)
    few = clean(spark, visit_rows(60)).where("admission_datetime IS NULL")
    table._merge(few).explain("formatted")
    filters = next(line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line)
    assert "= undated)" in filters and "key_slice" in filters


def test_a_batch_over_the_name_limit_merges_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wardlake.streaming.current_state.MAX_NAMED_PARTITIONS", 1)
    rows = visit_rows(60, seed=7)
    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2)
    for i, part in enumerate((rows[:30], rows[30:])):
        table.apply(clean(spark, part), i)
    assert state(table.read()) == state(latest_by_key(clean(spark, rows)))


def test_scratch_dir_is_below_the_checkpoint_folder(spark):
    path = scratch_dir(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert path != scratch_dir(spark, "x")


def test_a_running_stream_sees_files_that_come_later(spark, tmp_path):
    source = tmp_path / "in"
    write_csv(source, "a.csv", "P1,2024-01-01,30,DOC-1")
    bronze = f"{tmp_path}/bronze"
    stream = intake.csv_to_bronze(spark, str(source), bronze, f"{tmp_path}/one", every="1 second")
    try:
        stream.processAllAvailable()
        write_csv(source, "b.csv", "P2,2024-01-01,30,DOC-1")
        stream.processAllAvailable()
        assert {p["patient_id"] for p in payloads(spark, bronze)} == {"P1", "P2"}
    finally:
        assert not intake.run_for(stream, seconds=1)
    assert not stream.isActive


def test_from_files_to_prompts(spark, tmp_path):
    """The whole way: two deliveries of files, one of them with a corrected row."""
    from wardlake.operators import retrieval
    from wardlake.operators.access import secured
    from wardlake.plans.lake import Lake

    header = "Patient ID,Patient Admission Date,Patient Age,Department Referral,Patient WaitTime,Doctor ID,Patient Satisfaction Score"
    source, lake = tmp_path / "in", Lake(spark, f"{tmp_path}/lake")
    source.mkdir()
    visits = CurrentVisits(spark, lake.path("visits"), slices=2)
    doctors = spark.createDataFrame(
        [(" doc-1 ", "ann", "LEE", " cardiology ", "Heart", "U1", 12), (None, "x", "y", "z", "q", "u", 1)],
        "doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING, "
        "subspecialty STRING, university STRING, years_of_experience INT",
    )
    embedder = retrieval.hashed_words()

    def deliver(name, version, *rows):
        (source / name).write_text("\n".join([header, *rows]) + "\n")
        intake.csv_to_bronze(spark, str(source), lake.path("bronze"), lake.path("c1")).awaitTermination()
        bronze = stream_table(spark, lake.path("bronze"))
        visits_upsert(bronze, visits, lake.path("c2")).awaitTermination()
        lake.refresh_gold(visits.read(), doctors, unique_doctors=True)
        return {r.doc_id: r.op for r in lake.refresh_corpus(version, embedder).collect()}

    first = deliver("1.csv", 1, "P1,2024-01-05 10:00:00,30,cardiology,10,DOC-1,8",
                    "P2,05-01-2024 11:00,40,neurology,20,DOC-9,6", "N/A,2024-01-05,40,neurology,20,DOC-9,6")
    assert first == {
        "dept-Cardiology-2024-01-01": "insert", "dept-Neurology-2024-01-01": "insert",
        "doctor-DOC-1": "insert", "doctor-DOC-9": "insert",
    }
    second = deliver("2.csv", 2, "P1,05/01/2024 10:00,30,cardiology,50,DOC-1,8")
    assert second == {"dept-Cardiology-2024-01-01": "update", "doctor-DOC-1": "update"}
    assert lake.read("visits_enriched").count() == 2
    seen = secured(lake.read("department_monthly_stats"), ["dept_cardiology"]).collect()
    assert [(r.department_referral, r.visits, r.avg_wait_time) for r in seen] == [("Cardiology", 1, 50.0)]
    documents = lake.corpus(2).join(lake.vectors(2), "doc_id")
    questions = spark.createDataFrame([("q", "How long is the wait in the Cardiology department?")],
                                      "question_id STRING, question STRING")
    found = retrieval.retrieve(questions, documents, embedder, k=2)
    prompt = retrieval.prompt_rows(questions, retrieval.context_lines(found)).first().prompt
    lines = prompt.removeprefix("Context:\n").split("\n")
    assert {line.split("]")[0] for line in lines[:2]} == {"[dept-Cardiology-2024-01-01", "[doctor-DOC-1"}
    assert lines[2:] == ["", "Question: How long is the wait in the Cardiology department?"]


def test_stored_tables_get_a_name(spark, tmp_path):
    from wardlake.sources.tables import register_table
    from wardlake.streaming.current_state import PLACE, STORED

    table = CurrentVisits(spark, f"{tmp_path}/visits", slices=2)
    table.apply(clean(spark, visit_rows(30)), 0)
    try:
        named = register_table(
            spark, "silver_visits", table.path, STORED, "the patients' visits", {"quality": "silver"}, PLACE
        )
        assert state(named.drop(*PLACE)) == state(table.read())
        about = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED silver_visits").collect()}
        assert about["Comment"] == "the patients' visits" and "quality=silver" in about["Table Properties"]
    finally:
        spark.sql("DROP TABLE IF EXISTS silver_visits")
