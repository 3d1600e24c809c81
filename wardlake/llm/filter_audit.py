"""Filter interaction audit: what filters remove in every order, alone and together.

A document that fails some of the filters survives those subsets of filters that hold none of
them.  The subsets it survives are the bits of one word, its truth table.  How many words have
each bit set says how many documents survive each subset, and from that follow all
orders: what a step removes is the survivors of the filters before it less those with it.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PCT = 50
MOST_CAPITALS_PCT = 3
FORBIDDEN = b"#$%&*|"
CAPITALS = bytes(range(65, 91))

SUBSETS = 1 << len(FILTERS)
COPIED = FILTERS.index("E")
# A text that more than one row in so many has is heavy: there are fewer such texts than that.
HEAVY_ONE_IN = 1000
# Words of one carry-save row.
LANES = 64
# Parts that a task counts before it hands the numbers on.
PARTS_HELD = 2_000


def truth_table(failed: int) -> int:
    """The word of a document: bit s is set if subset s holds none of the filters in ``failed``."""
    return sum(1 << subset for subset in range(SUBSETS) if not subset & failed)


def own_failures(raw: bytes, n_chars: int) -> int:
    """The filters A to D that a text (its UTF-8 and its number of code points) fails, as bits."""
    words = raw.split()
    short = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT_PCT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS_PCT * n_chars
    marked = len(raw.translate(None, FORBIDDEN)) < len(raw)
    return short | repeated << 1 | loud << 2 | marked << 3


def set_bits(words: np.ndarray) -> np.ndarray:
    """How many of some 32-bit words have each bit set.

    Rows of words are added three at a time by carry-save adders, for all bits at once: a sum row of the same
    weight and a carry row of twice the weight.  Only the last two rows of a weight are counted bit by bit.
    """
    rows = -(-len(words) // LANES)
    level = np.zeros(rows * LANES, dtype=np.uint32)
    level[: len(words)] = words
    level = level.reshape(rows, LANES)
    counts = np.zeros(SUBSETS, dtype=np.int64)
    weight = 1
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * third :]])
        for bit in range(SUBSETS):
            counts[bit] += weight * int(((level >> np.uint32(bit)) & np.uint32(1)).sum())
        level = np.concatenate(carries) if carries else np.zeros((0, LANES), dtype=np.uint32)
        weight *= 2
    return counts


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """``doc_id, part, failed, digest``: the filters A to D that each text fails, and the SHA-256 of the text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for value in batch.column(2):
                whole = value.as_py() or ""
                raw = whole.encode("utf-8", "surrogatepass")
                failed.append(own_failures(raw, len(whole)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "failed", "digest"],
            )

    whole_part = F.coalesce(F.col(part).cast("string"), F.lit(""))
    picked = docs.select(F.col(doc_id).alias("doc_id"), whole_part.alias("part"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(judge, f"doc_id {kind}, part string, failed int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` of stored rows with a digest: filter E added where a smaller id has the same text.

    The smallest id of each text is found with partial results on every task.  The few texts that very many rows have
    are looked up where the rows are; the others meet their smallest id by digest.
    """
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = stored(least.where("n > 1"), "audit-copies")
    heavy = least.where(F.col("n") * HEAVY_ONE_IN > rows.count()).drop("n")
    found = rows.join(F.broadcast(heavy), "digest")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    found = found.unionByName(light.join(least.drop("n"), "digest", "left"))
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    failed = F.col("failed").bitwiseOR(F.when(copied, 1 << COPIED).otherwise(0))
    return found.select("doc_id", "part", failed.alias("failed"))


def survivors(rows: DataFrame) -> DataFrame:
    """``part, subset, n, good, toxic`` of rows ``part, failed, label``: documents that survive each subset.

    Label 0 counts a document, 1 a good one, 2 a toxic one, 3 one that is both.
    """
    tables = np.array([truth_table(failed) for failed in range(SUBSETS)], dtype=np.uint32)
    schema = pa.schema([("part", pa.string()), *((name, pa.int64()) for name in ("subset", "n", "good", "toxic"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows_out() -> Iterator[pa.RecordBatch]:
            for part, counted in totals.items():
                columns = [[part] * SUBSETS, range(SUBSETS), *counted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy()
            words = tables[batch.column(1).to_numpy()]
            labels = batch.column(2).to_numpy()
            for code, part in enumerate(parts.dictionary.to_pylist()):
                here = codes == code
                total = totals.setdefault(part, np.zeros((3, SUBSETS), dtype=np.int64))
                for at, wanted in enumerate(((0,), (1, 3), (2, 3))):
                    total[at] += set_bits(words[here & np.isin(labels, wanted)])
            if len(totals) >= PARTS_HELD:
                yield from rows_out()
                totals.clear()
        yield from rows_out()

    counted = rows.select("part", "failed", "label").mapInArrow(
        count, "part string, subset bigint, n bigint, good bigint, toxic bigint"
    )
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


REPORT = [
    ("part", "string"), ("filter_order", "string"), ("step", "int"), *(
        (name, "bigint")
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    ),
]


def order_rows(part: str, n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, every step, from the survivors of each subset."""
    orders = ["".join(order) for order in permutations(FILTERS)]
    everything = SUBSETS - 1
    steps, shares = [], dict.fromkeys(FILTERS, 0)
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            after = before | bit
            removed = n[before] - n[after]
            shares[letter] += removed
            steps.append((
                part, order, step, n[after], removed, n[0] - n[bit] - removed, n[everything ^ bit] - n[everything],
                good[before] - good[after], toxic[before] - toxic[after], letter,
            ))
            before = after
    return (row[:-1] + (shares[row[-1]],) for row in steps)


def every_order(survived: DataFrame) -> DataFrame:
    """The report of ``survivors``, 600 rows a part."""
    fields = F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic")))
    by_part = survived.groupBy("part").agg(fields.alias("s")).select("part", "s.n", "s.good", "s.toxic")
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in REPORT])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*order_rows(**row))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return by_part.mapInArrow(expand, ", ".join(f"{name} {kind}" for name, kind in REPORT))


def audited(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    part: str = "lang",
    label_id: str = "doc_id",
) -> DataFrame:
    """One row per part, order of the filters and step: see ``REPORT``.

    A null text is empty, a null part is the part ``""``.  A repeated row counts each time; neither of two rows of one
    id is a copy of the other.  A row without id is never a copy, has no label, and makes no other row a copy.  A document is good
    (toxic) if any of its labels has quality (toxic) 1.  Other columns are not read.  A text of any length is judged
    whole.  Without documents there are no rows; without labels none is lost.
    """
    rows = stored(judged(docs, text, doc_id, part), "audit-judged")
    rows = stored(with_copies(rows), "audit-failed")
    known = labels.select(
        F.col(label_id).alias("doc_id"),
        F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"),
        F.when(F.col("toxic") == 1, 2).otherwise(0).alias("toxic"),
    )
    known = known.groupBy("doc_id").agg((F.max("good") + F.max("toxic")).alias("label")).where("label > 0")
    labelled = rows.join(known, "doc_id").select("part", "failed", "label")
    return every_order(survivors(rows.select("part", "failed", F.lit(0).alias("label")).unionByName(labelled)))
