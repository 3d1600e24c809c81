"""Language model scores by a probabilistic suffix tree, beside a smoothed unigram score.

The symbols of the tree are the characters of the normalised text: its lower-cased words, joined by single blanks,
and an end.  A context of up to five symbols is kept if the symbols after it are distributed otherwise than after its
suffix, one symbol shorter: their divergence, times how often the context occurs, has to reach a bar that is the same
at every size of the corpus, so that the tree grows with it.  A symbol is predicted by the longest kept suffix of what
was before it, its counts smoothed by those of the next shorter one.

The tree is a table.  Documents are taken in chunks; a chunk's distinct runs of symbols meet the table in a join, and
their scores go back to the chunks.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.chunked import (
    CHUNKS_PER_PARTITION, ENTRY_BITS, PACKED, SLICE, Chunk, entries, packed_back, packed_numbers, summed, unpacked_numbers,
)
from wardlake.llm.common import in_fold, small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_OUT = (7, 2)
DEPTH = 5
# Contexts longer than this are judged and smoothed inside one partition, which holds all that end alike.
SHALLOW = 3
# A symbol takes ten bits: the end has one, the most frequent 1,022 characters one each, and the rarer ones share one.
BITS, OTHER, END, FIRST_OWN, SYMBOLS = 10, 0, 1, 2, 1024
CODE_POINTS = 0x110000
# The bar of the divergence test, in nats: so much, and so much more for each further symbol seen after the context,
# as chance alone makes counts diverge the more, the more kinds there are.
LEAST_GAIN, GAIN_A_KIND = 8.0, 1.0
END_WORD = ""  # no word is empty, so this stands for the end in the counts of words
# Symbols that are turned into runs at a time.
PIECE = 4_000_000
# Rows of runs that Python takes in at a time.
RUN_ROWS = 100_000
# Log10 probabilities travel as whole numbers of this share.
STEPS = 1 << 24


def normal(text: str | None) -> str:
    """The words between ASCII blanks, A-Z lower-cased, with one blank between them."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass") if text else ""


def code_points(normal_text: str) -> np.ndarray:
    return np.frombuffer(normal_text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def alphabet_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the code points, and the log10 probability of a code point among the shared ones."""
    own = np.argsort(-counts, kind="stable")[: SYMBOLS - FIRST_OWN]
    own = own[counts[own] > 0]
    symbols = np.full(CODE_POINTS, OTHER, dtype=np.uint16)
    symbols[own] = FIRST_OWN + np.arange(len(own))
    rare = np.where(symbols == OTHER, counts, 0).astype(np.float64)
    shared = np.log10((rare + 1) / (rare.sum() + CODE_POINTS - len(own)))
    shared[own] = 0.0
    return symbols, shared.astype(np.float32)


def learned_alphabet(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From the characters of all ``texts(text)``: at most one count per code point reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CODE_POINTS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                points = code_points(normal(text))
                if len(points):
                    part = np.bincount(points)
                    counts[: len(part)] += part
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["point", "n"])

    small_batches(texts.sparkSession)
    rows = texts.select("text").mapInArrow(count, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CODE_POINTS, dtype=np.int64)
    counts[rows["point"].to_numpy()] = rows["n"].to_numpy()
    return alphabet_of(counts)


def runs_of(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all runs of ``DEPTH`` symbols and the next one in a text, which begins after ends and ends with one."""
    for at in range(0, len(symbols) + 1, PIECE):
        piece = symbols[max(0, at - DEPTH) : at + PIECE].astype(np.int64)
        before = np.full(max(0, DEPTH - at), END, dtype=np.int64)
        last = at + PIECE > len(symbols)
        whole = np.concatenate([before, piece, [END]] if last else [before, piece])
        codes = np.zeros(len(whole) - DEPTH, dtype=np.int64)
        for k in range(DEPTH + 1):
            codes <<= BITS
            codes |= whole[k : k + len(codes)]
        yield codes


def counted_runs(texts: list[np.ndarray], trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of texts in order, and how often the texts to learn from hold each."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size = 0

    def settle() -> None:
        both = np.sort(np.concatenate(held))
        codes = both >> 1
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        found.append((codes[starts], np.add.reduceat(both & 1, starts)))
        held.clear()

    for text, train in zip(texts, trains):
        for codes in runs_of(text):
            held.append(codes << 1 | int(train))
            size += len(codes)
            if size >= PIECE:
                settle()
                size = 0
    if held:
        settle()
    if len(found) < 2:
        return found[0] if found else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    codes, counts = (np.concatenate(part) for part in zip(*found))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def packed_codes(codes: np.ndarray) -> bytes:
    """Codes in order, as the steps between them."""
    return packed_numbers(np.diff(codes, prepend=np.int64(0)), "<i8")


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked_numbers(data, "<i8"))


def read_symbols(row: dict) -> list[np.ndarray]:
    """The symbols of each document of a chunk."""
    sizes = unpacked_numbers(row["run_sizes"]).astype(np.int64)
    return np.split(unpacked_numbers(row["runs"], "<u2"), np.cumsum(sizes)[:-1])


# Of a chunk: its symbols, how many each document has, its distinct runs, and how often what is learned from holds each.
RUNS = ("runs", "run_sizes", "codes", "code_counts")


def chunks_of(docs: DataFrame, alphabet: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The chunks of ``docs(doc_id, text, weight)`` with the words, and the symbols, of their documents; stored."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((name, pa.binary()) for name in (*PACKED, *RUNS)),
         ("n_tokens", pa.list_(pa.int64())), ("shared", pa.list_(pa.float64()))]
    )
    spark_schema = ", ".join(
        ["chunk bigint", "doc_ids array<bigint>", *(f"{name} binary" for name in (*PACKED, *RUNS)),
         "n_tokens array<bigint>", "shared array<double>"]
    )
    sent = docs.sparkSession.sparkContext.broadcast(alphabet)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * CHUNKS_PER_PARTITION
        symbols, shared = sent.value
        chunk, runs, trains = Chunk(["n_tokens", "shared"]), [], []

        def row() -> pa.RecordBatch:
            chunk.extra["runs"] = packed_numbers(np.concatenate(runs), "<u2")
            chunk.extra["run_sizes"] = packed_numbers([len(r) for r in runs])
            codes, counts = counted_runs(runs, np.array(trains))
            chunk.extra["codes"], chunk.extra["code_counts"] = packed_codes(codes), packed_numbers(counts, "<i8")
            return chunk.row(number, schema)

        for batch in batches:
            for doc_id, text, weight in zip(*(column.to_pylist() for column in batch.columns)):
                whole = normal(text)
                words = [*(whole.split(" ") if whole else []), END_WORD]
                points = code_points(whole)
                runs.append(symbols.take(points))
                trains.append(weight)
                values = {"n_tokens": len(words), "shared": float(shared.take(points).sum(dtype=np.float64))}
                chunk.add(doc_id, len(whole), Counter(words), weight, values)
                if chunk.full():
                    yield row()
                    number, chunk, runs, trains = number + 1, Chunk(["n_tokens", "shared"]), [], []
        if chunk.ids:
            yield row()

    small_batches(docs.sparkSession)
    return stored(docs.select("doc_id", "text", "weight").mapInArrow(fill, spark_schema), "suffix-chunks", free=True)


def run_entries(chunks: DataFrame, weighted: bool = False) -> DataFrame:
    """One row per chunk and distinct run: ``code, ref``, or ``code, n`` with its count in what is learned from."""
    second = "n" if weighted else "ref"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = unpacked_codes(row["codes"])
                if weighted:
                    counts = unpacked_numbers(row["code_counts"], "<i8")
                else:
                    counts = (row["chunk"] << ENTRY_BITS) + np.arange(len(codes), dtype=np.int64)
                every = pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", second])
                for at in range(0, len(codes), SLICE):
                    yield every.slice(at, SLICE)

    columns = ["chunk", "codes", *(["code_counts"] if weighted else [])]
    return chunks.select(*columns).mapInArrow(unpack, f"code bigint, {second} bigint")


def _last(code: Column, symbols: int) -> Column:
    """The code of a run's last so many symbols."""
    return code.bitwiseAND((1 << BITS * symbols) - 1)


def _without_last(code: Column) -> Column:
    return F.call_function("shiftright", code, F.lit(BITS))


def shallow_counts(grams: DataFrame) -> list[DataFrame]:
    """For each depth of context from none to ``SHALLOW``: ``code, context, n`` of the runs of context and next symbol, with
    ``total`` and ``kinds``, the count of the context and of the symbols seen after it.  From ``grams(code, n)``,
    the runs of full depth.  A context has at most ``SYMBOLS`` runs.
    """
    counts, runs = [], grams
    for depth in range(SHALLOW, -1, -1):
        of_context = Window.partitionBy("context")
        full = stored(
            runs.groupBy(_last(F.col("code"), depth + 1).alias("code")).agg(F.sum("n").alias("n"))
            .withColumn("context", _without_last(F.col("code")))
            .withColumn("total", F.sum("n").over(of_context))
            .withColumn("kinds", F.sum((F.col("n") > 0).cast("bigint")).over(of_context)),
            "runs", free=True,
        )
        counts.append(full)
        runs = full
    return counts[::-1]


def _gains(n: np.ndarray, share: np.ndarray, shorter: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per group, by how much the shares of its runs gain on those after the shorter context."""
    seen = n > 0
    terms = n[seen] * np.log(share[seen] / shorter[seen])
    return np.bincount(group[seen], terms, minlength=groups)


def judged(code: np.ndarray, n: np.ndarray, shorter: np.ndarray, least: float, a_kind: float) -> tuple[np.ndarray, ...]:
    """``a, b, in_five, in_four`` of the runs of whole contexts of four symbols, these in any order, a context's runs in
    the order of their codes: the last symbol's probability is ``a + b * p`` where ``p`` is that after the last three symbols; and
    whether the context of five, and that of four, is kept.  ``shorter`` is its share after the last three.
    """
    n = n.astype(np.float64)
    four = np.cumsum(np.diff(_context_of_four(code), prepend=np.int64(-1)) != 0) - 1
    five_starts = np.flatnonzero(np.diff(code >> BITS, prepend=np.int64(-1)))
    five = np.repeat(np.arange(len(five_starts)), np.diff(np.append(five_starts, len(code))))
    total5, kinds5 = np.bincount(five, n), np.bincount(five, n > 0)
    runs4, first, at4 = np.unique(four << BITS | code & SYMBOLS - 1, return_index=True, return_inverse=True)
    n4, four4 = np.bincount(at4, n), runs4 >> BITS
    total4, kinds4 = np.bincount(four4, n4), np.bincount(four4, n4 > 0)
    share4 = n4 / np.maximum(total4, 1)[four4]
    gain4 = _gains(n4, share4, shorter[first], four4, len(total4))
    gain5 = _gains(n, n / np.maximum(total5, 1)[five], share4[at4], five, len(total5))
    keep5 = (kinds5 > 0) & (gain5 >= least + a_kind * (kinds5 - 1))
    keep4 = (kinds4 > 0) & (gain4 >= least + a_kind * (kinds4 - 1))
    keep4 |= np.bincount(four[five_starts], keep5) > 0
    some4, some5 = np.maximum(kinds4, 1), np.maximum(kinds5, 1)
    a = np.where(keep4[four4], n4 / (total4 + some4)[four4], 0.0)[at4]
    b = np.where(keep4, some4 / (total4 + some4), 1.0)[four]
    known, down = keep5[five], (total5 + some5)[five]
    a = np.where(known, (n + some5[five] * a) / down, a)
    b = np.where(known, some5[five] * b / down, b)
    return a.astype(np.float32), b.astype(np.float32), known, keep4[four]


def _context_of_four(code: np.ndarray) -> np.ndarray:
    return code >> BITS & (1 << 4 * BITS) - 1


def deep_runs(grams: DataFrame, least: float, a_kind: float) -> DataFrame:
    """``code, a, b, in_five, in_four`` of all runs of full depth, as ``judged``; stored.

    All runs whose context ends with the same three symbols are in one partition, in order of the fourth, so that a task holds one
    context of four symbols at a time, which has at most ``SYMBOLS`` squared runs.
    """
    schema = pa.schema([("code", pa.int64()), ("a", pa.float32()), ("b", pa.float32()), ("in_five", pa.bool_()), ("in_four", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: pa.Table) -> Iterator[pa.RecordBatch]:
            code, n, shorter = (held[name].to_numpy() for name in ("code", "n", "shorter"))
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in (code, *judged(code, n, shorter, least, a_kind))], schema=schema)
            for at in range(0, out.num_rows, SLICE):
                yield out.slice(at, SLICE)

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            contexts = _context_of_four(held["code"].to_numpy())
            if not len(contexts):
                continue
            others = np.flatnonzero(contexts != contexts[-1])  # the last context may go on
            if len(others):
                cut = int(others[-1]) + 1
                yield from rows(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from rows(held)

    ends = grams.select(
        "code", "n", _last(_without_last(F.col("code")), SHALLOW).alias("end"), _last(F.col("code"), 1).alias("next")
    ).repartition("end")
    after = Window.partitionBy("end", "next")
    shares = ends.withColumn("shorter", F.sum("n").over(after) / F.greatest(F.sum("n").over(Window.partitionBy("end")), F.lit(1)))
    by_fourth = _last(_without_last(F.col("code")), SHALLOW + 1)
    small_batches(grams.sparkSession, RUN_ROWS)
    ordered = shares.select("end", by_fourth.alias("fourth"), "code", "n", "shorter").sortWithinPartitions("end", "fourth", "code")
    spark_schema = "code bigint, a float, b float, in_five boolean, in_four boolean"
    return stored(ordered.select("code", "n", "shorter").mapInArrow(judge, spark_schema), "deep-runs", free=True)


def run_counts(grams: DataFrame, least: float = LEAST_GAIN, a_kind: float = GAIN_A_KIND) -> tuple[list[DataFrame], DataFrame]:
    """The counts of short contexts by depth, and the judged runs of full depth, from ``grams(code, n)``."""
    grams = stored(grams, "grams", free=True)
    return shallow_counts(grams), deep_runs(grams, least, a_kind)


def kept_contexts(
    counts: tuple[list[DataFrame], DataFrame], least: float = LEAST_GAIN, a_kind: float = GAIN_A_KIND
) -> list[DataFrame]:
    """For each depth the ``context`` codes that pass the divergence test, and the suffixes of those that do."""
    shallow, deep = counts
    context = _without_last(F.col("code"))
    kept: list[DataFrame] = [None] * (DEPTH + 1)
    kept[5] = deep.where("in_five").select(context.alias("context")).distinct()
    kept[4] = deep.where("in_four").select(_last(context, 4).alias("context")).distinct()
    for depth in range(SHALLOW, 0, -1):
        longer = shallow[depth].where("n > 0").withColumn("up", _last(F.col("code"), depth))
        shorter = shallow[depth - 1].where("n > 0").select(F.col("code").alias("up"), (F.col("n") / F.col("total")).alias("q"))
        gains = longer.join(shorter, "up").groupBy("context").agg(
            F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"), F.first("kinds").alias("kinds")
        )
        passed = gains.where(F.col("gain") >= least + a_kind * (F.col("kinds") - 1)).select("context")
        passed = passed.union(kept[depth + 1].select(_last(F.col("context"), depth).alias("context"))).distinct()
        kept[depth] = stored(passed, "contexts", free=True)
    return kept


def run_scores(counts: tuple[list[DataFrame], DataFrame], kept: list[DataFrame]) -> DataFrame:
    """``code, p`` of all runs of full depth: the probability of the last symbol after the longest kept suffix."""
    shallow, deep = counts
    p = shallow[0].select("code", ((F.col("n") + 0.5) / (F.col("total") + 0.5 * SYMBOLS)).alias("p"))
    for depth in range(1, SHALLOW + 1):
        runs = shallow[depth].withColumn("up", _last(F.col("code"), depth))
        runs = runs.join(kept[depth].withColumn("known", F.lit(True)), "context", "left")
        kinds = F.greatest(F.col("kinds"), F.lit(1))
        smoothed = (F.col("n") + kinds * F.col("shorter")) / (F.col("total") + kinds)
        shorter = p.select(F.col("code").alias("up"), F.col("p").alias("shorter"))
        p = runs.join(shorter, "up").select("code", F.when(F.col("known"), smoothed).otherwise(F.col("shorter")).alias("p"))
    shorter = p.select(F.col("code").alias("up"), F.col("p").alias("shorter"))
    of_runs = deep.select("code", "a", "b", _last(F.col("code"), SHALLOW + 1).alias("up")).join(shorter, "up")
    return of_runs.select("code", (F.col("a").cast("double") + F.col("b").cast("double") * F.col("shorter")).alias("p"))


class Lookup:
    """The values of known codes: a table of slots by hash, and a search for codes that share a slot with another."""

    FACTOR, LEAST_BITS, MOST_BITS = np.uint64(0x9E3779B97F4A7C15), 4, 23

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values
        bits = min(self.MOST_BITS, max(self.LEAST_BITS, (8 * len(codes)).bit_length()))
        self.shift = np.uint64(64 - bits)
        slots = self._slots(codes)
        self.table = np.zeros(1 << bits)
        self.table[slots] = values
        self.table[np.bincount(slots, minlength=1 << bits) > 1] = np.nan

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * self.FACTOR >> self.shift).view(np.int64)

    def total(self, codes: np.ndarray) -> float:
        """The sum of the values of ``codes``, all of them known."""
        found = self.table.take(self._slots(codes))
        shared = np.isnan(found)
        found[shared] = self.values.take(self.codes.searchsorted(np.sort(codes[shared])))
        return float(found.sum())


def symbol_scores(chunks: DataFrame) -> DataFrame:
    """``chunk, score``: the log10 probability of each document of a chunk, in order."""
    counts = run_counts(run_entries(chunks, weighted=True).groupBy("code").agg(F.sum("n").alias("n")))
    scores = run_scores(counts, kept_contexts(counts))
    scores = stored(scores.select("code", F.round(F.log10("p") * STEPS).cast("bigint").alias("number")), "run-scores", free=True)
    numbers = run_entries(chunks).join(scores, "code").select("ref", "number")
    # Written before the chunks are joined, so that the entries' shuffle files are gone by then.
    back = stored(packed_back(numbers), "packed-scores", free=True).groupBy("chunk").agg(F.collect_list(F.struct("at", "number")).alias("back"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, codes = read_symbols(row), unpacked_codes(row["codes"])
                values = np.empty(len(codes), dtype=np.float64)
                for part in row["back"]:
                    values[np.cumsum(unpacked_numbers(part["at"]), dtype=np.int64)] = unpacked_numbers(part["number"], "<i8")
                scores = Lookup(codes, values / STEPS)
                sums = [shared + sum(map(scores.total, runs_of(text))) for text, shared in zip(texts, row["shared"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]]), pa.array([sums], pa.list_(pa.float64()))], names=["chunk", "score"]
                )

    whole = chunks.select("chunk", "shared", "runs", "run_sizes", "codes").join(back, "chunk")
    return whole.mapInArrow(add_up, "chunk bigint, score array<double>")


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: tuple[int, int] = HELD_OUT) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Everything is learned from the documents outside the held-out fold; a null id is in no fold.  A null or empty text
    is one token, the end.  A very long text is read in pieces.  Rows may repeat and count as often as they are given;
    other columns are not read.  Without any training document no token is known and the tree knows nothing; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    held_out = in_fold(F.col(doc_id), *folds)
    alphabet = learned_alphabet(docs.where(~held_out).select(F.col(text).alias("text")))
    weight = F.when(held_out, 0).otherwise(1).cast("bigint")
    chunks = chunks_of(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), weight.alias("weight")), alphabet)
    counts = stored(
        entries(chunks, weighted=True).groupBy("word").agg(F.sum("weight").alias("number")), "word-counts", free=True
    )
    n, v = counts.agg(F.coalesce(F.sum("number"), F.lit(0)), F.count(F.when(F.col("number") > 0, 1))).first()
    numbers = entries(chunks).join(counts, "word").select("ref", "number")

    def values(c: np.ndarray) -> list[np.ndarray]:
        return [np.log10(c + 1.0), (c > 0).astype(np.int64)]

    with_scores = chunks.join(stored(symbol_scores(chunks), "symbol-scores", free=True), "chunk")
    extra = {"n_tokens": "bigint", "score": "double"}
    added = summed(with_scores, numbers, values, {"base_sum": "double", "n_known": "bigint"}, extra)
    small_batches(spark, 2000, 8 << 20)
    return added.select(
        "doc_id",
        in_fold(F.col("doc_id"), *folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        "score",
    )
