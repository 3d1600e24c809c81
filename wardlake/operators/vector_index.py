"""An index for exact retrieval: documents in cells around centres, of which a question reads those that can hold its best.

A cell knows the widest angle between its centre and a document.  By the triangle inequality on angles no
document of it is nearer to a question than the angle to the centre less that; a question that has found ``k`` documents
skips every cell that cannot hold a nearer one.  Questions meet cells in a join, so neither side passes the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.operators.retrieval import RANK_DIGITS, SCORE_DIGITS, TOP_K, _matrix, _usable
from wardlake.session import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of an index, by default and at most: their centres are broadcast and collected.
CELLS, MOST_CELLS = 256, 4_096
# Documents whose vectors the centres are fitted to, about, and the rounds of fitting.  Every document is indexed.
FITTED, ROUNDS = 200_000, 3
# Documents of one packed row, and questions that meet it together, about.
SHARD_ROWS, BLOCK_QUESTIONS = 4_096, 512
# Angles are compared with this slack, so that rounding never skips a cell.
SLACK = 1e-9


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _centres(documents: DataFrame, cells: int) -> np.ndarray:
    """Centres by a few rounds of spherical k-means on a sample chosen by id; at most ``cells`` rows come to the driver."""
    n = documents.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = documents.where(draw < int((1 << 20) * min(1.0, 2 * FITTED / max(n, 1)))) if n > FITTED else documents
    first = sample.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(cells).select("vector").toPandas()
    if not len(first):
        return np.zeros((0, 1))
    centres = np.unique(_matrix(first["vector"]), axis=0)
    for _ in range(ROUNDS):
        shared = sample.sparkSession.sparkContext.broadcast(centres)

        def sum_up(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), dtype=np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                unit = _matrix(batch["vector"])
                nearest = np.argmax(unit @ shared.value.T, axis=1)
                np.add.at(total, nearest, unit)
                np.add.at(count, nearest, 1)
            some = np.flatnonzero(count)
            if len(some):
                yield pd.DataFrame({"cell": some, "total": list(total[some])})

        found = sample.select("vector").mapInPandas(sum_up, "cell bigint, total array<double>")
        sums = found.select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        rows = sums.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("total")).orderBy("cell").toPandas()
        centres = np.array(rows["total"].to_list(), dtype=float)
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = (centres / norms)[norms[:, 0] > 0]
    return centres


def build_index(documents: DataFrame, path: str, cells: int = CELLS, shard_rows: int = SHARD_ROWS) -> None:
    """Write the index of ``documents(doc_id, vector)`` below ``path``: ``cells`` and packed ``shards``.

    Documents without a usable vector are left out, as in ``top_k``; vectors of zeros have a cell of their own.  A cell
    with very many documents is many shards.
    """
    spark = documents.sparkSession
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = documents.select("doc_id", F.col("vector").cast("array<float>").alias("vector")).where(usable)
    some = whole.where(F.exists("vector", lambda x: x != 0))
    centres = _centres(some, min(cells, MOST_CELLS))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            near = _matrix(batch["vector"]) @ shared.value.T if len(shared.value) else np.zeros((len(batch), 1))
            blank = batch["vector"].map(lambda v: not np.any(v)).to_numpy(dtype=bool)
            cell = np.where(blank, -1, np.argmax(near, axis=1))
            batch["cell"], batch["cosine"] = cell, np.where(blank, 0.0, near.max(axis=1))
            yield batch

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, vector array<float>, cell int, cosine double"
    placed = _stored(whole.mapInPandas(place, schema), f"{path}/placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table = _stored(sizes.join(known, "cell", "left"), f"{path}/cells")
    dealt = placed.join(F.broadcast(table.select("cell", "n")), "cell")
    shard = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / shard_rows)).alias("shard")
    packed = dealt.select("cell", shard, F.struct("doc_id", "vector").alias("d")).groupBy("cell", "shard").agg(F.collect_list("d").alias("d"))
    packed.select("cell", "shard", F.col("d.doc_id").alias("doc_ids"), F.col("d.vector").alias("vectors")).write.mode("overwrite").parquet(f"{path}/shards")


def _best_pairs(met: DataFrame, k: int, schema: str) -> DataFrame:
    """The best ``k`` documents of each shard for each question of a block."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.asarray(row.doc_ids)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                scores = np.round(_matrix(pd.Series(list(row.asked))) @ _matrix(pd.Series(list(row.vectors)))[order].T, RANK_DIGITS) + 0.0
                keep = min(k, len(ids))
                picks = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                yield pd.DataFrame({
                    "question_id": np.repeat(np.asarray(row.question_ids), keep), "doc_id": ids[picks.ravel()],
                    "score": np.take_along_axis(scores, picks, axis=1).ravel(),
                })

    return met.select("doc_ids", "vectors", "question_ids", "asked").mapInPandas(score, schema)


def indexed_top_k(
    questions: DataFrame, path: str, k: int = TOP_K, block_questions: int = BLOCK_QUESTIONS
) -> tuple[DataFrame, DataFrame]:
    """``question_id, rank, doc_id, score`` as ``top_k`` has them, and ``question_id, cells, vectors``: what each question read.

    ``questions`` has ``question_id, vector``, any number of them in one plan.  Each first reads the cells nearest to it, as many as hold
    ``k`` documents, then those that the k-th score found does not rule out.
    """
    spark: SparkSession = questions.sparkSession
    table = spark.read.parquet(f"{path}/cells")
    shards = spark.read.parquet(f"{path}/shards")
    rows = table.orderBy("cell").toPandas()
    real = rows[rows["cell"] >= 0]
    centres = np.array(real["centre"].to_list(), dtype=float)
    reach = np.arccos(np.clip(real["least"].to_numpy(dtype=float), -1, 1))
    shared = spark.sparkContext.broadcast((rows["cell"].to_numpy(), rows["n"].to_numpy(), centres, reach))
    question = questions.schema["question_id"].dataType.simpleString()
    document = shards.schema["doc_ids"].dataType.elementType.simpleString()
    pair_schema = f"question_id {question}, vector array<float>, cell int"

    def bounds(vectors: pd.Series) -> np.ndarray:
        """The highest score that a document of each cell may have."""
        cells, _, centres, reach = shared.value
        best = np.zeros((len(vectors), len(cells)))
        if len(centres):
            angle = np.arccos(np.clip(_matrix(vectors) @ centres.T, -1, 1))
            best[:, len(cells) - len(centres) :] = np.cos(np.maximum(angle - reach, 0))
        return best

    def first_cells(best: np.ndarray) -> np.ndarray:
        """True for the cells of the highest bounds that hold ``k`` documents together."""
        n = shared.value[1]
        order = np.argsort(-best, axis=1, kind="stable")
        ahead = np.cumsum(n[order], axis=1) - n[order]
        chosen = np.zeros(best.shape, dtype=bool)
        np.put_along_axis(chosen, order, ahead < k, axis=1)
        return chosen

    def pairs(batch: pd.DataFrame, chosen: np.ndarray) -> pd.DataFrame:
        asked, cell = np.nonzero(chosen)
        return pd.DataFrame({
            "question_id": batch["question_id"].to_numpy()[asked], "vector": batch["vector"].to_numpy()[asked], "cell": shared.value[0][cell],
        })

    def go_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[_usable(batch["vector"])]
            if len(batch):
                yield pairs(batch, first_cells(bounds(batch["vector"])))

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            best = bounds(batch["vector"])
            yield pairs(batch, (best >= batch["least"].to_numpy()[:, None] - SLACK) & ~first_cells(best))

    asked = questions.select("question_id", F.col("vector").cast("array<float>").alias("vector"))
    n_blocks = max(1, -(-asked.count() // block_questions))

    def met(chosen: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        chosen = _stored(chosen, scratch_dir(spark, f"index-{label}"))
        block = F.pmod(F.xxhash64("question_id"), F.lit(n_blocks)).alias("block")
        blocks = chosen.select("cell", block, F.struct("question_id", "vector").alias("q")).groupBy("cell", "block").agg(F.collect_list("q").alias("q"))
        blocks = blocks.select("cell", F.col("q.question_id").alias("question_ids"), F.col("q.vector").alias("asked"))
        found = _best_pairs(shards.join(blocks, "cell"), k, f"question_id {question}, doc_id {document}, score double")
        return _stored(found, scratch_dir(spark, f"index-{label}-found")), chosen

    nearest = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    found, first = met(asked.mapInPandas(go_first, pair_schema), "first")
    least = ranked(found).groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
    further, second = met(
        asked.join(least, "question_id").mapInPandas(go_on, pair_schema), "further"
    )
    score = (F.round("score", SCORE_DIGITS) + 0.0).alias("score")
    every = ranked(found.unionByName(further)).select("question_id", "rank", "doc_id", score)
    read = first.unionByName(second).join(F.broadcast(table.select("cell", "n")), "cell")
    return every, read.groupBy("question_id").agg(F.count("*").alias("cells"), F.sum("n").alias("vectors"))
