"""Text vectors, nearest documents per question, and the prompt rows made of them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Python workers get the functions of this module with the job, so that they need no
# copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How many documents answer a question, and the instruction given with them.
TOP_K = 6
SYSTEM_PROMPT = (
    "You are an assistant for emergency room operations. Answer ONLY from the provided context. "
    "If the context does not contain the answer, say you don't know. "
    "Cite the doc_ids you used in square brackets, e.g. [dept-Orthopedics-2024-01]."
)

DIMENSIONS = 256
# Nearness is compared at this many digits, so equal vectors tie wherever they are computed;
# scores are given at fewer.
RANK_DIGITS, SCORE_DIGITS = 12, 6

# Questions that one reading of the documents answers at most, and the size of their vectors.
BLOCK_QUESTIONS = 16384
BLOCK_BYTES = 64 << 20
# Tasks that read the documents at most, per core: a task hands on its best for every question,
# so that few long tasks hand on little.
TASKS_PER_CORE = 4

Embedder = Callable[[Column], Column]


def term_slots(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector slot of every word of the whole text, repeats included."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.crc32(w) % dimensions).cast("int"))


def hashed_words(dimensions: int = DIMENSIONS) -> Embedder:
    """An embedder: word counts per hashed slot, at length one.

    Words are split and hashed in the JVM; numpy only counts the slots of a batch.
    """

    def to_vector(slots: pd.Series) -> pd.Series:
        lengths = slots.map(lambda s: 0 if s is None else len(s)).to_numpy(dtype=np.int64)
        rows = np.repeat(np.arange(len(slots)), lengths)
        filled = [s for s in slots if s is not None and len(s)]
        flat = np.concatenate(filled) if filled else np.empty(0, dtype=np.int64)
        counts = np.bincount(rows * dimensions + flat, minlength=len(slots) * dimensions)
        counts = counts.reshape(len(slots), dimensions).astype(np.float64)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        return pd.Series(list(unit.astype(np.float32)))

    # Called non-deterministic, so that no filter on a vector makes Spark compute it twice.
    as_vectors = F.pandas_udf(to_vector, ArrayType(FloatType())).asNondeterministic()
    return lambda text: as_vectors(term_slots(text, dimensions))


def embed_changes(feed: DataFrame, embedder: Embedder) -> DataFrame:
    """``doc_id, op, vector`` of a change feed; only inserted and updated texts are embedded."""
    written = feed.where("op <> 'delete'").select("doc_id", "op", embedder(F.col("text")).alias("vector"))
    removed = feed.where("op = 'delete'").select(
        "doc_id", "op", F.lit(None).cast("array<float>").alias("vector")
    )
    return written.unionByName(removed)


def refresh_vectors(vectors: DataFrame, embedded: DataFrame) -> DataFrame:
    """The vector table after a change feed: old vectors of unchanged documents stay."""
    kept = vectors.join(embedded.select("doc_id"), "doc_id", "left_anti").select("doc_id", "vector")
    return kept.unionByName(embedded.where("op <> 'delete'").select("doc_id", "vector"))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit_rows(np.stack(vectors.to_list()).astype(np.float32).astype(float))


def _best(asked: np.ndarray, questions: np.ndarray, documents: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of some documents for each question, ties by document id."""
    documents = documents.sort_values("doc_id")
    ids = documents["doc_id"].to_numpy()
    scores = np.round(questions @ _matrix(documents["vector"]).T, RANK_DIGITS) + 0.0
    keep = min(k, len(ids))
    least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
    picks = []
    for line, bound in zip(scores, least):
        near = np.flatnonzero(line >= bound)
        picks.append(near[np.argsort(-line[near], kind="stable")[:keep]])
    rows = np.repeat(np.arange(len(asked)), keep)
    picks = np.concatenate(picks)
    return pd.DataFrame(
        {"question_id": asked[rows], "doc_id": ids[picks], "score": scores[rows, picks]}
    )


def _best_of_both(one: pd.DataFrame, other: pd.DataFrame, k: int) -> pd.DataFrame:
    both = pd.concat([one, other]).sort_values(["score", "doc_id"], ascending=[False, True])
    return both.groupby("question_id", sort=False).head(k)


def _usable(vectors: pd.Series) -> pd.Series:
    """True for vectors that are there and hold finite numbers only."""
    return vectors.map(lambda v: v is not None and bool(np.isfinite(np.asarray(v, dtype=float)).all()))


def _scan(documents: DataFrame, questions: pd.DataFrame, k: int, schema: str) -> DataFrame:
    """Score documents where they are; each task hands on its best ``k`` per question."""
    shared = documents.sparkSession.sparkContext.broadcast(
        (questions["question_id"].to_numpy(), _matrix(questions["vector"]))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            batch = batch[_usable(batch["vector"])]
            if len(batch):
                found = _best(*shared.value, batch, k)
                best = found if best is None else _best_of_both(best, found, k)
        if best is not None:
            yield best

    return documents.mapInPandas(scan, schema)


def _blocks(questions: DataFrame, most: int, most_bytes: int) -> Iterator[pd.DataFrame]:
    """The questions with a usable vector, in blocks of bounded number and size."""
    block, size = [], 0
    for row in questions.toLocalIterator():
        block.append((row["question_id"], row["vector"]))
        size += 4 * len(row["vector"] or ())
        if len(block) >= most or size >= most_bytes:
            yield pd.DataFrame(block, columns=["question_id", "vector"])
            block, size = [], 0
    if block:
        yield pd.DataFrame(block, columns=["question_id", "vector"])


def _nearest(
    questions: DataFrame,
    documents: DataFrame,
    k: int,
    block_questions: int = BLOCK_QUESTIONS,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, bool]:
    """The result of ``top_k``, and whether it is known to be small."""
    spark = documents.sparkSession
    schema = (
        f"question_id {questions.schema['question_id'].dataType.simpleString()}, "
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double"
    )
    as_floats = F.col("vector").cast("array<float>").alias("vector")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    stored = documents.select("doc_id", as_floats).coalesce(tasks)
    scored, n_blocks = spark.createDataFrame([], schema), 0
    for block in _blocks(questions.select("question_id", as_floats), block_questions, block_bytes):
        block = block[_usable(block["vector"])]
        if len(block):
            found = _scan(stored, block, k, schema)
            scored = scored.union(found) if n_blocks else found
            n_blocks += 1
    nearest = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    score = (F.round("score", SCORE_DIGITS) + 0.0).alias("score")
    return ranked.select("question_id", "rank", "doc_id", score), n_blocks <= 1


def top_k(
    questions: DataFrame,
    documents: DataFrame,
    k: int = TOP_K,
    block_questions: int = BLOCK_QUESTIONS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``question_id, rank, doc_id, score``: the ``k`` documents nearest to each question.

    Exact cosine over all documents; scores never leave a task but for its best ``k`` per
    question.  ``questions`` has ``question_id, vector``, ``documents`` has ``doc_id, vector``; both ids are
    unique.  Rows without a vector, or with a NaN or an infinite component, are left out; a vector of
    zeros is equally far from everything (score 0).

    The questions go to the documents in blocks of bounded number and size; the documents are read in
    place, once per block.
    """
    return _nearest(questions, documents, k, block_questions, block_bytes)[0]


def retrieve(
    questions: DataFrame,
    documents: DataFrame,
    embedder: Embedder,
    k: int = TOP_K,
    block_questions: int = BLOCK_QUESTIONS,
) -> DataFrame:
    """Top documents for question texts: ``question_id, rank, doc_id, text, score``.

    ``questions`` has ``question_id, question``; ``documents`` has ``doc_id, text, vector``.
    What one block of questions finds is ``k`` rows each and goes to the texts, not the texts to it.
    """
    asked = questions.select("question_id", embedder(F.col("question")).alias("vector"))
    found, few = _nearest(asked, documents.select("doc_id", "vector"), k, block_questions)
    texts = documents.select("doc_id", "text")
    return texts.join(F.broadcast(found) if few else found, "doc_id").select(
        "question_id", "rank", "doc_id", "text", "score"
    )


def context_lines(retrieved: DataFrame) -> DataFrame:
    """One context per question: its documents as ``[doc_id] text`` lines in rank order."""
    line = F.format_string("[%s] %s", "doc_id", "text")
    ranked = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return retrieved.groupBy("question_id").agg(ranked.alias("ranked")).select(
        "question_id", F.array_join(F.col("ranked.line"), "\n").alias("context")
    )


def prompt_rows(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``question_id, system, prompt`` for every question; no context found leaves it empty."""
    prompt = F.concat(
        F.lit("Context:\n"), F.coalesce("context", F.lit("")),
        F.lit("\n\nQuestion: "), F.col("question"),
    )
    return questions.join(contexts, "question_id", "left").select(
        "question_id", F.lit(SYSTEM_PROMPT).alias("system"), prompt.alias("prompt")
    )
