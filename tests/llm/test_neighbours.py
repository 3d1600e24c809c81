import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, r int"


def exact(rows, query, k):
    q = np.array(rows[query], dtype=np.float64)
    far = sorted((math.sqrt(((np.array(v, dtype=np.float64) - q) ** 2).sum()), i) for i, v in rows.items() if i != query)
    return far[:k]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "n", 1) for i, v in rows], SCHEMA)


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = dict(enumerate(vectors.tolist()))
    found = neighbours.nearest(frame(spark, list(rows.items())), F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for query in range(0, 3000, 100):
        got = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(s, i) for _, s, i in got] == sorted((s, i) for _, s, i in got)
        want = dict((i, s) for s, i in exact(rows, query, 10))
        hits += sum(i in want for _, _, i in got)
        assert all(abs(s - want[i]) < 1e-12 for _, s, i in got if i in want)
    assert hits >= 0.9 * 300


def test_copies_ties_and_rows_that_take_no_part(spark):
    base = [[float(x), 1.0, 0.5] for x in range(30)]
    rows = list(enumerate(base)) + [(100 + i, base[0]) for i in range(200)]
    odd = [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 1.0]), (503, [float("nan")] * 3), (504, [float("inf"), 1.0, 1.0]),
           (None, base[1]), (505, [1.0, 2.0]), (505, []), (3, base[3])]
    found = neighbours.nearest(frame(spark, rows + odd), F.col("vec_id") % 100 == 0).collect()
    for query in (0, 100, 200):
        got = [(r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert got == exact(dict(rows), query, 10)
    assert {r["query_id"] for r in found} == {0, 100, 200}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    rows = dict((i, [float(i + 1), 2.0]) for i in range(n))
    found = neighbours.nearest(frame(spark, list(rows.items())), F.col("vec_id") % 100 == 0).collect()
    want = exact(rows, 0, 10) if n else []
    assert [(r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == want


def hits_of(found, x, queries):
    hits = 0
    for query in queries:
        far = np.sqrt(((x.astype(np.float64) - x[query].astype(np.float64)) ** 2).sum(axis=1))
        far[query] = np.inf
        hits += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == query})
    return hits


def test_near_copies_beside_an_outlier(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2500, 16)).astype(np.float32)
    x[:1000] = x[0] * (1 + 1e-4 * rng.standard_normal((1000, 16)))
    x[1700] = 1e30
    found = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 100 == 0).collect()
    queries = range(0, 2500, 100)
    assert all(sum(r["query_id"] == q for r in found) == 10 for q in queries)
    assert hits_of(found, x, [q for q in queries if q < 1000]) >= 0.95 * 100
    assert hits_of(found, x, [q for q in queries if q > 1000 and q != 1700]) >= 0.95 * 130


def test_walks_go_on_to_the_end(spark):
    nodes = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id bigint, vec array<float>")
    graph = spark.createDataFrame([(i, [(1.0, i + 1)] if i < 9 else []) for i in range(10)], f"id bigint, links {neighbours.LINKS}")
    starts = spark.createDataFrame([(0, [0.0], 0)], "query_id bigint, vec array<float>, node bigint")
    assert {r["node"] for r in neighbours.walked(graph, nodes, starts).collect()} == set(range(10))


def test_rows_of_one_id_and_vectors_of_several_lengths(spark):
    rows = [(0, [0.5, 1.0]), (0, [9.0, 1.0]), (0, [9.0, 1.0]), (1, [0.0, 1.0]), (2, [8.0, 1.0]), (7, [0.5, 1.0]), (100, [1.0, 1.0, 1.0]), (101, [2.0, 1.0, 1.0])]
    found = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, k=2).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    # The two vectors of id 0 are two queries, and each is a candidate of the other.
    assert got == sorted([(0, 1, 7, 0.0), (0, 2, 1, 0.5), (0, 1, 2, 1.0), (0, 2, 0, 8.5), (100, 1, 101, 1.0)])


def test_recall_of_twelve_thousand_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((12_000, 64)).astype(np.float32)
    found = neighbours.nearest(frame(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 100 == 0).collect()
    assert hits_of(found, x, range(0, 12_000, 100)) >= 0.95 * 1200
