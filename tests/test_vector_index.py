"""The index of vectors against the scan."""

import numpy as np
import pytest

from wardlake.operators.retrieval import top_k
from wardlake.operators.vector_index import build_index, indexed_top_k

ROW = "vector array<float>"


def groups_of_vectors(rng, n, groups=12, d=16):
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, d))).astype(np.float32)


def rows_of(vectors, start=0):
    return [(start + i, [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("cells, shard_rows", [(8, 50), (1, 10_000), (64, 7)])
def test_the_same_rows_as_the_scan(spark, tmp_path, cells, shard_rows):
    rng = np.random.default_rng(cells)
    near = groups_of_vectors(rng, 300)
    odd = [(900, None), (901, [0.0] * 16), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15)]
    copies = [(1_000 + i, [float(x) for x in near[0]]) for i in range(40)]
    documents = spark.createDataFrame(rows_of(near) + odd + copies, f"doc_id bigint, {ROW}")
    asked = rows_of(groups_of_vectors(rng, 20)) + [(50, [0.0] * 16), (51, None), (52, [float("nan")] * 16), (53, [float(x) for x in near[0]])]
    questions = spark.createDataFrame(asked, f"question_id bigint, {ROW}")
    build_index(documents, str(tmp_path), cells, shard_rows)
    found, read = indexed_top_k(questions, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, top_k(questions, documents).collect()))
    assert {r["question_id"] for r in read.collect()} == {q for q, v in asked if v and v[0] == v[0]}


def test_many_questions_read_a_share_of_the_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    documents = spark.createDataFrame(rows_of(groups_of_vectors(rng, 2_000)), f"doc_id bigint, {ROW}")
    # More questions than one block of the scan takes.
    questions = spark.createDataFrame(rows_of(groups_of_vectors(rng, 17_000)), f"question_id bigint, {ROW}").repartition(4)
    build_index(documents, str(tmp_path), cells=24)
    rng = np.random.default_rng(1)
    near = spark.createDataFrame(rows_of(groups_of_vectors(rng, 500)), f"question_id bigint, {ROW}")
    found, read = indexed_top_k(near, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, top_k(near, documents).collect()))
    assert read.agg({"vectors": "avg"}).first()[0] < 0.5 * 2_000
    assert indexed_top_k(questions, str(tmp_path), k=2)[0].count() == 2 * 17_000


def test_no_documents_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], f"doc_id bigint, {ROW}")
    some = spark.createDataFrame([(1, [1.0, 2.0])], f"question_id bigint, {ROW}")
    build_index(none, f"{tmp_path}/none")
    assert indexed_top_k(some, f"{tmp_path}/none")[0].collect() == []
    build_index(some.withColumnRenamed("question_id", "doc_id"), f"{tmp_path}/one")
    assert indexed_top_k(some.limit(0), f"{tmp_path}/one")[0].collect() == []
    assert [tuple(r) for r in indexed_top_k(some, f"{tmp_path}/one")[0].collect()] == [(1, 1, 1, 1.0)]
