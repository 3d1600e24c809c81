"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily from each query.

Vectors that are equal are one node.  Random-projection trees deal the nodes into blocks, in which
each gets its first neighbours.  Then neighbours of neighbours are compared, round by
round: at every node the vectors of its neighbours, both ways, meet, and each learns which of the others are nearer than
what it has, until few learn more.  A query walks the graph from its own node, always on from the nearest nodes not yet
left, until its pool has none.  All use the original vectors; what is kept of distances comes from differences in double precision.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import sent, small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBOURS = 40  # kept per node of the graph
TREES = 4
BLOCK = 800  # nodes that are compared with each other at first, about
# Nodes that the trees' medians are taken from, about: so many, and of large tables one in so many.
TREE_SAMPLE, SAMPLED = 20_000, 1_000
GROUP_NUMBERS = 1 << 22  # components in a group that a task splits on by itself, about
SETTLED = 0.01  # share of new links with which the rounds end
OFFERED = 20  # nearer nodes that one meeting offers to each of its members
# A query's nearest nodes kept, whatever the size of the table: the graph, which grows with it, has to lead on.  At least ``k`` times FEWEST.
POOL, FEWEST = 320, 4
STEP = 0.3  # share of the pool that is left per walk
NUMBERS = 1 << 20  # components that are held at once in the small steps

LINKS = "array<struct<d:double,id:bigint>>"
LINK_TYPE = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, each once.

    Rows take no part if the id or the vector is null, a component is null or not finite, or all are zero.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    ).where(~bad & F.exists("embedding", lambda x: x != 0))
    return stored(good.distinct(), "vectors")


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed up one component after the other like ``distance_between``, to the last bit."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for j in range(a.shape[-1]):
        total += np.square(a[..., j] - b[..., j])
    return np.sqrt(total)


class Trees:
    """Random directions, one per level, and at each node the median of a sample along it."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.levels = levels
        self.directions = rng.standard_normal((trees, levels, sample.shape[1] if sample.size else 1))
        self.medians = np.zeros((trees, 1 << levels))
        for t in range(trees):
            node = np.ones(len(sample), dtype=np.int64)
            for level in range(levels):
                along = sample @ self.directions[t, level]
                order = np.lexsort((along, node))
                ends = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                full = np.flatnonzero(np.diff(ends))
                self.medians[t, (1 << level) + full] = along[order[(ends[full] + ends[full + 1] - 1) // 2]]
                node = 2 * node + (along > self.medians[t, node])

    def blocks(self, vectors: np.ndarray) -> np.ndarray:
        """One column per tree: the number of the leaf of each vector, the tree's number included."""
        out = []
        for t in range(len(self.directions)):
            node = np.ones(len(vectors), dtype=np.int64)
            for level in range(self.levels):
                node = 2 * node + (vectors @ self.directions[t, level] > self.medians[t, node])
            out.append((t << self.levels + 1) + node)
        return np.stack(out, axis=1)


def _merged(links: Column, keep: int) -> Column:
    """The nearest ``keep`` different nodes of a list of links."""
    return F.slice(F.array_sort(F.array_distinct(links)), 1, keep)


def first_links(nodes: DataFrame, keep: int = NEIGHBOURS, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """``id, links``: the nearest nodes in the blocks of all trees."""
    spark = nodes.sparkSession
    n = nodes.count()
    share = min(1.0, max(TREE_SAMPLE, n / SAMPLED) / max(1, n))
    sample = nodes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toArrow()
    matrix = rows_of(sample["vec"].combine_chunks())
    deepest = max(0, int(math.log2(max(1, len(sample)) / 8)))
    levels = min(deepest, max(0, math.ceil(math.log2(max(1, n) / block))))
    packed = sent(spark, Trees(matrix, trees, levels))

    def leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = cloudpickle.loads(packed.value)
        for vectors in batches:
            yield pa.array(list(forest.blocks(rows_of(vectors))) if len(vectors) else [], type=pa.list_(pa.int64()))

    leaves.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    dealt = nodes.select("id", "vec", F.explode(F.arrow_udf(leaves, "array<bigint>")(F.col("vec"))).alias("block"))
    # A task splits a larger block on by itself; only one that is too large for a task is dealt on by hash, in each tree otherwise.
    most = max(3 * block, GROUP_NUMBERS // max(1, matrix.shape[1]))
    sizes = dealt.groupBy("block").agg(F.count("*").alias("size"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / most)).cast("bigint")
    split = dealt.join(sizes, "block").withColumn(
        "part", F.pmod(F.xxhash64("block", "id"), parts).cast("bigint")
    )

    def leaves_of(x: np.ndarray) -> Iterator[np.ndarray]:
        rng, open_ = np.random.default_rng(len(x)), [np.arange(len(x))]
        while open_:
            rows = open_.pop()
            if len(rows) <= 2 * block:
                yield rows
                continue
            order = np.argpartition(x[rows] @ rng.standard_normal(x.shape[1]), len(rows) // 2)
            open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]

    def compare(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        every = rows_of(group["vec"].combine_chunks())
        out: list = [None] * len(ids)
        for leaf in leaves_of(every):
            x = every[leaf] - np.median(every[leaf], axis=0)
            norms, k = np.einsum("ij,ij->i", x, x), min(keep, len(leaf) - 1)
            many = max(1, NUMBERS // (x.shape[1] * keep))
            for at in range(0, len(leaf), many):
                d = norms[at : at + many, None] + norms[None, :] - 2 * (x[at : at + many] @ x.T)
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(d), 0), dtype=np.int64)
                far = between(every[leaf[at : at + many], None], every[leaf[near]])
                for row, places, apart in zip(leaf[at : at + many], leaf[near], far):
                    out[row] = [{"d": float(f), "id": int(ids[p])} for f, p in zip(apart, places)]
        return pa.table({"id": group["id"], "links": pa.array(out, type=LINK_TYPE)})

    found = split.select("block", "part", "id", "vec").groupBy("block", "part").applyInArrow(compare, f"id bigint, links {LINKS}")
    return found.groupBy("id").agg(_merged(F.flatten(F.collect_list("links")), keep).alias("links"))


def both_ways(graph: DataFrame, keep: int) -> DataFrame:
    """``id, other`` along links and against them; of those that point to a node its nearest ``keep``."""
    there = graph.select("id", F.explode("links").alias("l")).select("id", F.col("l.id").alias("other"), F.col("l.d").alias("d"))
    ranked = Window.partitionBy("id").orderBy("d", "other")
    back = (
        there.select(F.col("other").alias("id"), F.col("id").alias("other"), "d")
        .withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= keep)
    )
    return there.select("id", "other").union(back.select("id", "other")).distinct()


def descended(graph: DataFrame, nodes: DataFrame, keep: int = NEIGHBOURS, offered: int = OFFERED) -> DataFrame:
    """One round: at every node its neighbours meet and offer each other; ``fresh`` counts a node's new links."""
    worst = graph.select("id", F.when(F.size("links") < keep, F.lit(float("inf"))).otherwise(F.element_at("links", -1)["d"]).alias("worst"))
    members = nodes.join(worst, "id").select(F.col("id").alias("other"), "vec", "worst")
    meetings = both_ways(graph, keep // 2).join(members, "other").select("id", "other", "vec", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            centres = now["id"].to_numpy()
            if not len(centres):
                continue
            cut = int(np.searchsorted(centres, centres[-1], side="left"))  # the last meeting may go on
            held = now.slice(cut)
            if cut:
                yield offers(now.slice(0, cut))
        if held is not None and held.num_rows:
            yield offers(held)

    def offers(rows: pa.Table) -> pa.RecordBatch:
        centres, ids = rows["id"].to_numpy(), rows["other"].to_numpy()
        x, worst = rows_of(rows["vec"].combine_chunks()), rows["worst"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], centres[1:] != centres[:-1]]))
        sizes = np.diff(np.append(starts, len(centres)))
        owners, lists = [], []
        many = max(1, NUMBERS // (x.shape[1] * 2 * keep))
        for at in range(0, len(starts), many):
            some = slice(at, at + many)
            first, size = starts[some], sizes[some]
            most = int(size.max())
            place = np.minimum(first[:, None] + np.arange(most)[None, :], len(ids) - 1)
            real = np.arange(most)[None, :] < size[:, None]
            whole = x[place]
            # Near copies are told apart about one of them; the member of the median norm is no outlier.
            norms = np.where(real, np.einsum("cmk,cmk->cm", whole, whole), np.inf)
            middle = np.take_along_axis(np.argsort(norms, axis=1), (size[:, None] - 1) // 2, axis=1)
            v = whole - np.take_along_axis(whole, middle[:, :, None], axis=1)
            norms = np.einsum("cmk,cmk->cm", v, v)
            d = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            # The sums round: a little more than what is nearer is looked at.
            slack = 1e-14 * (norms[:, :, None] + norms[:, None, :])
            allowed = real[:, :, None] & real[:, None, :] & (d - slack < np.square(worst[place])[:, :, None])
            allowed[:, np.arange(most), np.arange(most)] = False
            d = np.where(allowed, np.maximum(d, 0), np.inf)
            k = min(offered, most)
            near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
            c, m, j = np.nonzero(np.isfinite(np.take_along_axis(d, near, axis=2)))
            mine, others = place[c, m], place[c, near[c, m, j]]
            far = np.concatenate([between(x[mine[i : i + 4096]], x[others[i : i + 4096]]) for i in range(0, len(mine) + 1, 4096)])
            fine = far < worst[mine]
            mine, meeting, far, others = ids[mine[fine]], (c * most + m)[fine], far[fine], ids[others[fine]]
            cuts = np.flatnonzero(np.diff(meeting, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(mine))):
                owners.append(int(mine[a]))
                lists.append([{"d": float(y), "id": int(z)} for y, z in zip(far[a:b], others[a:b])])
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(lists, LINK_TYPE)], names=["id", "links"])

    small_batches(graph.sparkSession, 8192)
    found = meetings.repartition("id").sortWithinPartitions("id").mapInArrow(meet, f"id bigint, links {LINKS}")
    old = graph.select("id", "links", F.col("links.id").alias("old"))
    every = old.union(found.withColumn("old", F.lit(None).cast("array<bigint>"))).groupBy("id").agg(
        _merged(F.flatten(F.collect_list("links")), keep).alias("links"), F.first("old", ignorenulls=True).alias("old")
    )
    return every.select("id", "links", F.size(F.array_except(F.col("links.id"), "old")).alias("fresh"))


def neighbour_graph(nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, links`` of every node of ``nodes(id, vec)``, nearest first; each round is written.

    The rounds end when few links are new, or after ``rounds``.
    """
    graph, done = stored(first_links(nodes), "graph"), 0
    links = graph.agg(F.coalesce(F.sum(F.size("links")), F.lit(0))).first()[0]
    while links and (rounds is None or done < rounds):
        after = stored(descended(graph, nodes), "graph")
        fresh, links = after.agg(F.sum("fresh"), F.sum(F.size("links"))).first()
        graph, done = after.select("id", "links"), done + 1
        if fresh <= SETTLED * links:
            break
    return graph


def walked(graph: DataFrame, nodes: DataFrame, starts: DataFrame, pool: int = POOL) -> DataFrame:
    """``query_id, node`` of each query's nearest ``pool`` nodes found; ``starts`` has ``query_id, vec, node``.

    In each walk a query goes on from its nearest nodes not yet left, to all that they are linked with, either way;
    the walks end when no query has such a node in its pool.
    """

    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(between(rows_of(a), rows_of(b)), pa.float64())

    distance.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    far = F.arrow_udf(distance, "double").asNondeterministic()
    # Packed per node, so that a walk reads one row for each node it leaves.
    around = stored(both_ways(graph, NEIGHBOURS).groupBy("id").agg(F.collect_list("other").alias("others")), "around")
    asking = starts.select("query_id", F.col("vec").alias("asked"))
    seen = starts.select("query_id", "node", F.lit(0.0).alias("d"), F.lit(True).alias("open"))
    nearest = Window.partitionBy("query_id").orderBy("d", "node")
    openly = Window.partitionBy("query_id", "open").orderBy("d", "node")
    step = math.ceil(STEP * pool)
    while True:
        top = seen.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= pool)
        top = stored(top.withColumn("go", F.col("open") & (F.row_number().over(openly) <= step)), "walk")
        if top.where("go").isEmpty():
            return top.select("query_id", "node")
        reached = (
            top.where("go").join(around, F.col("node") == F.col("id"))
            .select("query_id", F.explode("others").alias("node")).distinct()
            .join(top.select("query_id", "node"), ["query_id", "node"], "left_anti")
        )
        met = (
            reached.join(nodes.select(F.col("id").alias("node"), "vec"), "node").join(asking, "query_id")
            .select("query_id", "node", far("vec", "asked").alias("d"), F.lit(True).alias("open"))
        )
        seen = top.select("query_id", "node", "d", (F.col("open") & ~F.col("go")).alias("open")).union(met)


def distance_between(a: Column, b: Column) -> Column:
    """Euclidean distance, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(
    vectors: DataFrame, queries_where: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", rounds: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found to each row that ``queries_where`` (on ``vec_id``) picks.

    Nearest first, ties to the smaller id; the query's own row is no candidate, equal vectors of other ids are.
    With fewer than ``k`` candidates all are given.  Rows that take no part (see ``usable``) are neither queries nor candidates.  Only
    vectors of one length have a distance: each length is searched by itself.  A row that repeats in id and vector counts once; unlike vectors
    of one id are rows of their own, each with its own answers.  An empty table gives no rows; other columns are not read.
    """
    small_batches(vectors.sparkSession, 4096)
    rows = usable(vectors, vec_id, embedding)
    lengths = [r[0] for r in rows.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    found = [nearest_of(rows.where(F.size("embedding") == n), queries_where, k, rounds) for n in lengths or [0]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest_of(rows: DataFrame, queries_where: Column, k: int, rounds: int | None) -> DataFrame:
    """The result of ``nearest`` for ``rows(vec_id, embedding)``, different and of one length."""
    # Of equal vectors a query may need the k + 1 of the smallest ids.
    equal = Window.partitionBy("embedding")
    first = rows.withColumn("r", F.row_number().over(equal.orderBy("vec_id"))).where(F.col("r") <= k + 1)
    # A node is named by its least id and a hash of its vector, as an id may have several vectors.
    members = stored(first.withColumn("id", F.xxhash64(F.min("vec_id").over(equal), "embedding")), "members")
    nodes = stored(members.where("r = 1").select("id", "embedding"), "nodes")
    slim = nodes.select("id", F.col("embedding").alias("vec"))
    graph = neighbour_graph(slim, rounds)
    asked = rows.where(queries_where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    starts = asked.join(nodes, F.col("asked") == F.col("embedding")).select(
        F.struct(F.col("query_id").alias("id"), F.col("id").alias("own")).alias("query_id"), "asked", F.col("id").alias("node")
    )
    starts = stored(starts, "starts")
    small_batches(rows.sparkSession, 4096)
    found = walked(graph, slim, starts.select("query_id", F.col("asked").alias("vec"), "node"), max(POOL, FEWEST * k))
    scored = (
        found.join(nodes.select(F.col("id").alias("node"), "embedding"), "node").join(starts.select("query_id", "asked"), "query_id")
        .select("query_id", F.col("node").alias("id"), distance_between(F.col("asked"), F.col("embedding")).alias("score"))
    )
    every = scored.join(members.select("vec_id", "id"), "id").where("vec_id != query_id.id OR id != query_id.own")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query_id.id").alias("query_id"), "rank", "vec_id", "score"
    )
