"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import pretokens
from wardlake.llm.common import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0  # the id that ends a document
# Pieces that one task packs together, about: enough for every gap to find its piece.
PIECES_PER_GROUP = 50_000

PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[dict]:
    """The pieces of a document given as little-endian unsigned 32-bit ids, the separator added."""
    ids += SEPARATOR.to_bytes(4, "little")
    step = 4 * capacity
    return [
        {"piece": k, "start": k * capacity, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
        for k, part in enumerate(ids[at : at + step] for at in range(0, len(ids), step))
    ]


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that finds the tightest fit.

    Leaf ``c`` holds the bins with ``c`` left; an inner node tells whether any leaf below has one.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        node = left + self.size
        while node:
            self.filled[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The bin with the least capacity left of at least ``need``, taken out; (left, bin)."""
        filled, node = self.filled, need + self.size
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        left = node - self.size
        number = self.bins[left].pop()
        while node:
            filled[node] -= 1
            node >>= 1
        return left, number


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the tightest open bin."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, opened = OpenBins(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = tree.take_tightest(need)
        if found is None:
            left, number = capacity, opened
            opened += 1
        else:
            left, number = found
        bins[i], offsets[i] = number, capacity - left
        if left > need:
            tree.put(left - need, number)
    return bins, offsets


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``; the ids themselves stay in the task."""

    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = pretokens.WordCoder(tokenizer_path)
        kind = pa.list_(pa.struct([
            ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ]))
        for batch in texts:
            yield pa.array([pieces_of(ids, capacity) for ids in coder.ids(batch.to_pylist())], type=kind)

    cut.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.arrow_udf(cut, PIECE).asNondeterministic()(F.col(text)).alias("pieces")
    ).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty: one piece with the separator alone.  Repeated documents and null ids are
    packed like any others; an empty table gives no rows; no other column is read.  Full
    pieces are sequences of their own.  The rest are dealt evenly over groups by the row's number,
    so copies and repeated ids spread too, and each group is packed longest first, each piece into the tightest
    open sequence.  A group wastes about one open sequence, of some thousands.
    """
    # The rows' numbers are written with them, so a task that runs again finds the same.
    pieces = stored(
        tokenised_pieces(docs, tokenizer_path, text, doc_id, capacity).withColumn("row", F.monotonically_increasing_id()),
        "packing",
    )
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // pieces_per_group))

    def pack(group: pa.Table) -> pa.Table:
        order = group.sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets = best_fit(order["length"].to_pylist(), capacity)
        first = order["g"][0].as_py() << 40
        kept = order.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint")
    some = rest.withColumn("g", group).groupBy("g").applyInArrow(pack, full.schema)
    return full.unionByName(some)
