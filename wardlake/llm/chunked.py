"""Numbers known per distinct word, brought to the documents that hold the words.

Documents are taken together in chunks.  A chunk keeps a list of its distinct words and, per document,
which of them it holds how often.  Only the words travel: each distinct word of all chunks meets its number in a
join, the numbers go back to the chunks, and a chunk sums them per document.  A word that is in every
document is one row per chunk, so no word is heavy.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A chunk ends after the document with which it has so many characters, distinct words or documents.
CHUNK_CHARS, CHUNK_WORDS, CHUNK_DOCUMENTS = 13_500_000, 220_000, 20_000
CHUNKS_PER_PARTITION = 1 << 14
ENTRY_BITS = 28


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_numbers(values, kind: str = "<u4") -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    flat = np.ascontiguousarray(values, dtype=kind)
    return _squeezed(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes())


def unpacked_numbers(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(_whole(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_words(words: list[str]) -> tuple[bytes, bytes]:
    """Words as one text of bytes and the length of each."""
    raw = [word.encode("utf-8", "surrogatepass") for word in words]
    return _squeezed(b"".join(raw)), packed_numbers([len(word) for word in raw])


def unpacked_words(data: bytes, lengths: bytes) -> pa.Array:
    ends = np.cumsum(unpacked_numbers(lengths), dtype=np.int32)
    offsets = np.concatenate([np.zeros(1, dtype=np.int32), ends])
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(_whole(data)))


class Chunk:
    def __init__(self, extra: list[str]):
        # A word that is asked for the first time gets the next number.
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.weights = np.zeros(0, dtype=np.int64)
        self.ids: list = []
        self.sizes: list[int] = []
        self.gaps: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.extra: dict[str, list] = {name: [] for name in extra}
        self.chars = 0

    def add(self, doc_id, n_chars: int, counted: Counter, weight: int, extra: dict) -> None:
        words = self.words
        places = np.fromiter(map(words.__getitem__, counted), dtype=np.uint32, count=len(counted))
        times = np.fromiter(counted.values(), dtype=np.uint32, count=len(counted))
        order = np.argsort(places)
        places, times = places[order], times[order]
        if weight:
            if len(self.weights) < len(words):
                self.weights = np.concatenate([self.weights, np.zeros(len(words) - len(self.weights) + 50_000, dtype=np.int64)])
            self.weights[places] += times.astype(np.int64) * weight
        self.ids.append(doc_id)
        self.sizes.append(len(places))
        self.gaps.append(np.diff(places, prepend=np.uint32(0)))
        self.times.append(times)
        for name, value in extra.items():
            self.extra[name].append(value)
        self.chars += n_chars

    def full(self) -> bool:
        return self.chars >= CHUNK_CHARS or len(self.words) >= CHUNK_WORDS or len(self.ids) >= CHUNK_DOCUMENTS

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        nothing = np.empty(0, dtype=np.uint32)
        weights = np.zeros(len(self.words), dtype=np.int64)
        weights[: len(self.weights)] = self.weights[: len(self.words)]
        words, word_lengths = packed_words(list(self.words))
        columns = {
            "chunk": number, "words": words, "word_lengths": word_lengths, "weights": packed_numbers(weights, "<i8"),
            "doc_ids": self.ids, "sizes": packed_numbers(self.sizes),
            "gaps": packed_numbers(np.concatenate([*self.gaps, nothing])),
            "times": packed_numbers(np.concatenate([*self.times, nothing])), **self.extra,
        }
        return pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in schema], schema=schema)


KINDS = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
PACKED = ("words", "word_lengths", "weights", "sizes", "gaps", "times")
# Rows that go from a task to Spark together.
SLICE = 20_000


def chunked(
    docs: DataFrame, cutter: Callable[[], Callable[[str | None], tuple[list[str], dict]]], extra: dict[str, str]
) -> DataFrame:
    """The chunks of ``docs(doc_id, text, weight)``, written and read again.

    ``cutter()``, called once per task, gives a function from a text to its words and the document's ``extra``
    values, a name and a type each.  Words of a document count ``weight`` times each in ``weights``.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((name, pa.binary()) for name in PACKED)]
        + [(name, pa.list_(KINDS[kind])) for name, kind in extra.items()]
    )
    spark_schema = ", ".join(
        ["chunk bigint", "doc_ids array<bigint>", *(f"{name} binary" for name in PACKED), *(f"{n} array<{k}>" for n, k in extra.items())]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * CHUNKS_PER_PARTITION
        cut, chunk = cutter(), Chunk(list(extra))
        for batch in batches:
            for doc_id, text, weight in zip(*(column.to_pylist() for column in batch.columns)):
                words, values = cut(text)
                chunk.add(doc_id, len(text or ""), Counter(words), weight, values)
                if chunk.full():
                    yield chunk.row(number, schema)
                    number, chunk = number + 1, Chunk(list(extra))
        if chunk.ids:
            yield chunk.row(number, schema)

    return stored(docs.select("doc_id", "text", "weight").mapInArrow(fill, spark_schema), "chunks")


def entries(chunks: DataFrame, weighted: bool = False) -> DataFrame:
    """One row per chunk and word: ``word, ref``, or ``word, weight`` with the word's count in the chunk."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpacked_words(row["words"], row["word_lengths"])
                if weighted:
                    second = pa.array(unpacked_numbers(row["weights"], "<i8"))
                else:
                    second = pa.array((row["chunk"] << ENTRY_BITS) + np.arange(len(words), dtype=np.int64))
                every = pa.RecordBatch.from_arrays([words, second], names=["word", "weight" if weighted else "ref"])
                for at in range(0, len(words), SLICE):
                    yield every.slice(at, SLICE)

    columns = ["chunk", "words", "word_lengths", *(["weights"] if weighted else [])]
    return chunks.select(*columns).mapInArrow(unpack, "word string, " + ("weight bigint" if weighted else "ref bigint"))


def packed_back(numbers: DataFrame) -> DataFrame:
    """``chunk, at, number``: the rows ``ref, number`` of a task, packed for each chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, values, size = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            ref, value = np.concatenate(refs), np.concatenate(values)
            order = np.argsort(ref, kind="stable")
            ref, value = ref[order], value[order]
            chunk = ref >> ENTRY_BITS
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(ref))):
                at = (ref[a:b] & ((1 << ENTRY_BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(chunk[a])]), pa.array([packed_numbers(np.diff(at, prepend=np.uint32(0)))], pa.binary()),
                     pa.array([packed_numbers(value[a:b], "<i8")], pa.binary())],
                    names=["chunk", "at", "number"],
                )

        for batch in batches:
            refs.append(batch.column(0).to_numpy())
            values.append(batch.column(1).to_numpy())
            size += batch.num_rows
            if size >= 1_000_000:
                yield from rows()
                refs, values, size = [], [], 0
        if size:
            yield from rows()

    return numbers.select("ref", "number").mapInArrow(pack, "chunk bigint, at binary, number binary")


def summed(
    chunks: DataFrame,
    numbers: DataFrame,
    value_of: Callable[[np.ndarray], list[np.ndarray]],
    sums: dict[str, str],
    extra: dict[str, str],
) -> DataFrame:
    """One row per document: its id, its ``extra`` values, and sums over its words.

    ``numbers`` has ``ref, number`` for every entry.  ``value_of`` turns a chunk's numbers into one
    array per sum; a document's sum counts each word as often as the document holds it.
    """
    back = packed_back(numbers).groupBy("chunk").agg(F.collect_list(F.struct("at", "number")).alias("back"))
    kept = chunks.select("chunk", "doc_ids", "sizes", "gaps", "times", *extra)
    fields = {"doc_id": "bigint", **extra, **sums}
    schema = pa.schema([(name, KINDS[kind]) for name, kind in fields.items()])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name).slice(k, 1) for name in batch.schema.names}
                sizes = unpacked_numbers(row["sizes"][0].as_py()).astype(np.int64)
                places = np.cumsum(unpacked_numbers(row["gaps"][0].as_py()), dtype=np.int64)
                times = unpacked_numbers(row["times"][0].as_py())
                starts = np.concatenate([[0], np.cumsum(sizes)])
                # Places begin anew in each document: running sums less what was before it.
                places -= np.repeat(np.concatenate([[0], places])[starts[:-1]], sizes)
                parts = row["back"][0].as_py() or []
                at = [np.cumsum(unpacked_numbers(p["at"]), dtype=np.int64) for p in parts]
                values = np.zeros(1 + max((int(a[-1]) for a in at), default=0), dtype=np.int64)
                for where, part in zip(at, parts):
                    values[where] = unpacked_numbers(part["number"], "<i8")
                columns = [row["doc_ids"].flatten(), *(row[name].flatten() for name in extra)]
                for (_, kind), value in zip(sums.items(), value_of(values)):
                    full = np.flatnonzero(sizes)  # documents with words
                    total = np.zeros(len(sizes), dtype=np.float64 if kind == "double" else np.int64)
                    if len(full):
                        total[full] = np.add.reduceat(value[places] * times, starts[:-1][full])
                    columns.append(pa.array(total))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    # Chunks in which no document has a word meet no number.
    return kept.join(back, "chunk", "left").drop("chunk").mapInArrow(add_up, out)
