"""Sentences, the merge and its change feed, vectors and retrieval."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardlake.operators import corpus, merge, retrieval
from wardlake.plans.lake import Lake
from wardlake.session import scratch_dir

DOCS = "doc_id STRING, doc_type STRING, department STRING, period STRING, text STRING"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_sentences(spark):
    monthly = spark.createDataFrame(
        [("Orthopedics", date(2024, 1, 1), 3, 25.0, 5.5, 2, 50.0, None, 20.7), ("Neurology", None, 1, None, None, 0, 0.0, 0.0, None)],
        "department_referral STRING, admission_month DATE, visits BIGINT, avg_wait_time DOUBLE, avg_satisfaction DOUBLE, "
        "satisfaction_responses BIGINT, admission_rate_pct DOUBLE, coordinator_usage_pct DOUBLE, avg_age DOUBLE",
    )
    first, second = corpus.department_docs(monthly).collect()
    assert (first.doc_id, first.period, first.department) == ("dept-Orthopedics-2024-01-01", "2024-01-01", "Orthopedics")
    assert first.text == (
        "In 2024-01-01, the Orthopedics department had 3 visits, an average wait time of 25.0 minutes, "
        "an average satisfaction score of 5.5 (2 responses), an admission rate of 50.0% and coordinator "
        "usage of n/a%. Average patient age was 20.7."
    )
    assert (second.doc_id, second.period) == ("dept-Neurology", None)
    doctor = corpus.doctor_docs(spark.createDataFrame(
        [("DOC-1", None, None, None, None, None, None, 2, 1.5, None, 0, 100.0, 0.0)],
        "doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING, subspecialty STRING, "
        "university STRING, years_of_experience INT, visits BIGINT, avg_wait_time DOUBLE, avg_satisfaction DOUBLE, "
        "satisfaction_responses BIGINT, admission_rate_pct DOUBLE, coordinator_usage_pct DOUBLE",
    )).first()
    assert (doctor.doc_id, doctor.doc_type, doctor.period) == ("doctor-DOC-1", "doctor", None)
    assert doctor.text == (
        "Dr. n/a n/a works in n/a (n/a), studied at n/a and has n/a years of experience. Across 2 visits: "
        "average wait time 1.5 minutes, average satisfaction n/a (0 responses), admission rate 100.0%, "
        "coordinator usage 0.0%."
    )


OLD = [("a", "t", "d", None, "x"), ("b", "t", "d", "p", "x"), ("c", "t", "d", None, "x"), ("e", "t", None, None, "x")]
NEW = [("a", "t", "d", None, "x"), ("b", "t", "d", None, "x"), ("d", "t", "d", None, "x"), ("e", "t", None, None, "y")]


def bag(df):
    return sorted(map(tuple, df.select("doc_id", "text", "department", "period", "doc_type").collect()), key=str)


def test_merge_laws(spark):
    old, new = docs(spark, OLD), docs(spark, NEW)
    classified = merge.classify(old, new)
    assert {r.doc_id: r.op for r in classified.collect()} == {
        "a": "unchanged", "b": "update", "c": "delete", "d": "insert", "e": "update",
    }
    feed = merge.change_feed(classified)
    assert {r.doc_id: (r.op, r.text) for r in feed.collect()}["c"] == ("delete", "x")
    assert bag(merge.merged(classified)) == bag(new)
    assert bag(merge.apply_changes(old, feed)) == bag(new)
    assert merge.changes(new, new).count() == 0
    assert {r.op for r in merge.changes(docs(spark, []), new).collect()} == {"insert"}


def test_duplicate_key_fails(spark):
    twice = docs(spark, NEW + [("a", "t", "d", None, "z")])
    with pytest.raises(PySparkException, match="duplicate doc_id: a"):
        merge.changes(docs(spark, OLD), twice).collect()


def test_corpus_versions(spark):
    lake = Lake(spark, scratch_dir(spark, "lake"))
    months = "department_referral STRING, admission_month DATE, visits BIGINT, avg_wait_time DOUBLE, avg_satisfaction DOUBLE, " \
        "satisfaction_responses BIGINT, admission_rate_pct DOUBLE, coordinator_usage_pct DOUBLE, avg_age DOUBLE"
    people = "doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING, subspecialty STRING, " \
        "university STRING, years_of_experience INT, visits BIGINT, avg_wait_time DOUBLE, avg_satisfaction DOUBLE, " \
        "satisfaction_responses BIGINT, admission_rate_pct DOUBLE, coordinator_usage_pct DOUBLE"

    def month(name, visits):
        return (name, date(2024, 1, 1), visits, 1.0, 2.0, 3, 4.0, 5.0, 6.0)

    embedder = retrieval.hashed_words(16)
    lake.write("doctor_performance", spark.createDataFrame([], people))
    lake.write("department_monthly_stats", spark.createDataFrame([month("A", 1), month("B", 1)], months))
    assert {r.op for r in lake.refresh_corpus(1, embedder).collect()} == {"insert"}
    lake.write("department_monthly_stats", spark.createDataFrame([month("A", 1), month("C", 1)], months))
    for _ in range(2):  # running a version again changes nothing
        feed = lake.refresh_corpus(2, embedder)
        assert {(r.op, r.department) for r in feed.collect()} == {("insert", "C"), ("delete", "B")}
        assert {r.department for r in lake.corpus(2).collect()} == {"A", "C"}
        assert {r.doc_id for r in lake.vectors(2).collect()} == {"dept-A-2024-01-01", "dept-C-2024-01-01"}


def test_hashed_words(spark):
    frame = spark.createDataFrame([("The the WAIT", 1), ("", 2), (None, 3), ("wait", 4)], "text STRING, i INT")
    vectors = {r.i: r.v for r in frame.select("i", retrieval.hashed_words(64)(F.col("text")).alias("v")).collect()}
    first = np.array(vectors[1])
    assert np.isclose(np.linalg.norm(first), 1) and sorted(first[first > 0].round(4)) == [0.4472, 0.8944]
    assert not any(vectors[2]) and not any(vectors[3])
    assert np.flatnonzero(vectors[4])[0] in np.flatnonzero(first)


def brute_force(questions, documents, k):
    def unit(v):
        v = np.asarray(v, np.float32).astype(float)
        n = np.linalg.norm(v)
        return v / n if n else v

    found = set()
    for q, qv in questions:
        scores = sorted((-round(float(unit(qv) @ unit(dv)), 12) + 0.0, d) for d, dv in documents)
        found |= {(q, i + 1, d, round(-s, 6) + 0.0) for i, (s, d) in enumerate(scores[:k])}
    return found


@pytest.mark.parametrize("limits", [{}, {"block_questions": 3}, {"block_bytes": 40}])
def test_top_k_is_exact(spark, limits):
    rng = random.Random(5)
    # Few distinct vectors: many exact ties, which the id decides.
    documents = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)]) for i in range(300)]
    questions = [(f"q{i}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(11)] + [("zero", [0.0] * 4)]
    got = retrieval.top_k(
        spark.createDataFrame(questions, "question_id STRING, vector ARRAY<FLOAT>"),
        spark.createDataFrame(documents, "doc_id INT, vector ARRAY<FLOAT>").repartition(7),
        6, **limits,
    )
    assert {(r.question_id, r.rank, r.doc_id, r.score) for r in got.collect()} == brute_force(questions, documents, 6)


def test_fewer_documents_than_k_and_none(spark):
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "question_id STRING, vector ARRAY<FLOAT>")
    schema = "doc_id STRING, vector ARRAY<FLOAT>"
    two = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("c", None)], schema)
    assert [(r.rank, r.doc_id) for r in retrieval.top_k(questions, two).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    assert retrieval.top_k(questions, spark.createDataFrame([], schema)).collect() == []
    assert retrieval.top_k(questions.limit(0), two).collect() == []


def test_odd_vectors_take_no_rank(spark):
    schema = "doc_id STRING, vector ARRAY<FLOAT>"
    odd = [("a", [float("nan"), 1.0]), ("b", [float("inf"), 0.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [-1.0, 0.0])]
    questions = spark.createDataFrame([("q", [1.0, 0.0]), ("n", [float("nan"), 0.0])], "question_id STRING, vector ARRAY<FLOAT>")
    found = retrieval.top_k(questions, spark.createDataFrame(odd, schema)).orderBy("rank").collect()
    assert [(r.question_id, r.rank, r.doc_id, r.score) for r in found] == [("q", 1, "d", 0.0), ("q", 2, "e", -1.0)]


def test_a_text_is_embedded_once(spark, capsys):
    embedder = retrieval.hashed_words()
    feed = spark.createDataFrame([("a", "insert", "x y"), ("b", "delete", None)], "doc_id STRING, op STRING, text STRING")
    embedded = retrieval.embed_changes(feed, embedder).where("vector IS NOT NULL")
    embedded.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    documents = feed.select("doc_id", embedder(F.col("text")).alias("vector"))
    questions = spark.createDataFrame([("q", [1.0] + [0.0] * 255)], "question_id STRING, vector ARRAY<FLOAT>")
    retrieval.top_k(questions, documents).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("block_questions", [10, 1])
def test_retrieve_gives_texts_in_rank_order(spark, block_questions):
    embedder = retrieval.hashed_words()
    texts = [("d1", "wait in cardiology"), ("d2", "wait in neurology"), ("d3", "doctors"), ("d4", None)]
    documents = spark.createDataFrame(texts, "doc_id STRING, text STRING").withColumn("vector", embedder(F.col("text")))
    asked = spark.createDataFrame(
        [("q1", "Cardiology: wait?"), ("q2", "neurology"), ("q3", "doctors")], "question_id STRING, question STRING"
    )
    rows = retrieval.retrieve(asked, documents, embedder, 2, block_questions).collect()
    first = {r.question_id: (r.doc_id, r.text) for r in rows if r.rank == 1}
    assert first == {"q1": texts[0], "q2": texts[1], "q3": texts[2]} and len(rows) == 6


def test_context_and_prompt(spark):
    found = spark.createDataFrame(
        [("q1", 2, "d2", "two", 0.1), ("q1", 1, "d1", "one", 0.2)],
        "question_id STRING, rank INT, doc_id STRING, text STRING, score DOUBLE",
    )
    asked = spark.createDataFrame([("q1", "How long?"), ("q2", "Why?")], "question_id STRING, question STRING")
    rows = retrieval.prompt_rows(asked, retrieval.context_lines(found)).collect()
    prompts = {r.question_id: r.prompt for r in rows}
    assert prompts == {
        "q1": "Context:\n[d1] one\n[d2] two\n\nQuestion: How long?",
        "q2": "Context:\n\n\nQuestion: Why?",
    }
    assert {r.system for r in rows} == {retrieval.SYSTEM_PROMPT}


def test_gold_tables_of_a_lake(spark, tmp_path):
    from wardlake.operators import rollups
    from wardlake.plans import landed, testdata
    from wardlake.plans.lake import DECLARED

    sf_dir = "/root/testdata/sf0.001"
    lake = Lake(spark, str(tmp_path))
    lake.refresh_gold(landed.visits(spark, sf_dir), testdata.doctors_raw(spark, sf_dir))
    for name in rollups.ROLLUPS:
        stored, direct = lake.read(name), landed.rollup(spark, sf_dir, name)
        assert stored.columns == direct.columns
        assert sorted(stored.collect(), key=str) == sorted(direct.collect(), key=str)
    for name, ddl in DECLARED.items():
        assert lake.read(name).columns == [c.split()[0] for c in ddl.split(",")]
    docs = corpus.insight_docs(lake.read("department_monthly_stats"), lake.read("doctor_performance"))
    feed = lake.refresh_corpus(1)
    assert feed.count() == docs.count() > 0


def test_doctors_are_broadcast_and_visits_stay_in_place(spark, capsys):
    from wardlake.operators.enrich import enrich_visits
    from wardlake.plans import landed

    sf_dir = "/root/testdata/sf0.001"
    enrich_visits(landed.visits(spark, sf_dir), landed.doctors(spark, sf_dir)).explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin LeftOuter BuildRight" in plan and "hashpartitioning" not in plan


def test_workers_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(retrieval._best))
    code = (
        "import pickle, numpy as np, pandas as pd\n"
        "best = pickle.load(open('f.pkl', 'rb'))\n"
        "docs = pd.DataFrame({'doc_id': ['a', 'b'], 'vector': [[1.0, 0.0], [0.0, 1.0]]})\n"
        "print(best(np.array(['q']), np.array([[0.0, 1.0]]), docs, 1)['doc_id'][0])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "b", done.stderr


def test_a_refresh_that_fails_leaves_the_table(spark, tmp_path):
    from wardlake.plans.lake import Lake

    lake = Lake(spark, str(tmp_path))
    good = docs(spark, [("a", "t", "d", "p", "x")])
    lake.write("corpus/version=1", good.select("text", "doc_id", "doc_type", "department", "period"))
    assert lake.corpus(1).columns == ["doc_id", "doc_type", "department", "period", "text"]
    half = spark.range(0, 8, numPartitions=8).select(
        F.when(F.col("id") < 7, F.col("id").cast("string")).alias("doc_id"),
        *[F.lit("y").alias(c) for c in ("doc_type", "department", "period", "text")],
    )
    with pytest.raises(PySparkException, match="doc_id is null"):
        lake.write("corpus/version=1", half)
    assert [tuple(r) for r in lake.corpus(1).collect()] == [("a", "t", "d", "p", "x")]
    lake.write("corpus/version=1", docs(spark, [("b", "t", "d", "p", "x")]))
    assert [r.doc_id for r in lake.corpus(1).collect()] == ["b"]


def test_doctors_keep_columns_that_are_not_declared(spark, tmp_path):
    from wardlake.plans.lake import Lake, silver_doctors

    raw = spark.createDataFrame(
        [(" doc-1 ", "ann", "LEE", " cardiology ", "Heart", "U1", 12, "x")],
        "doctor_id STRING, doctor_first_name STRING, doctor_last_name STRING, department STRING, "
        "subspecialty STRING, university STRING, years_of_experience INT, room STRING",
    )
    clean = silver_doctors(raw.select("room", *raw.columns[:-1]))
    assert clean.columns == raw.columns and clean.first().room == "x"
    assert Lake(spark, str(tmp_path)).write("doctors", clean).columns == raw.columns


def test_rows_without_a_sequence_are_quarantined_in_batch_too(spark, tmp_path):
    import json

    from wardlake.plans.lake import Lake

    rows = [(json.dumps({"patient_id": f"P{i}", "patient_admission_date": "2024-01-01"}), "2024-03-01T00:00:00Z" if i else "") for i in range(3)]
    bronze = spark.createDataFrame(rows, "value STRING, timestamp_bronze STRING").select(F.parse_json("value").alias("payload"), "timestamp_bronze")
    lake = Lake(spark, str(tmp_path))
    assert lake.refresh_visits(bronze).count() == 2
    assert [r.patient_id for r in lake.read("visits_quarantine").collect()] == ["P0"]
