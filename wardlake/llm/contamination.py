"""Benchmark decontamination: a generalised suffix automaton of the test items reads the documents.

The items' words become numbers; one automaton knows every run of words of every item.
A document's words walk through it, and at each word the automaton tells the longest run,
ending there, that some item holds.  Where that run is a window long, a window ends.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches, stored, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Consecutive words of an item that count as a hit; a shorter item is one window.
WINDOW = 13
# A document is contaminated if its hit words are at least one in so many.
ONE_IN = 20
# Words of test items that one automaton holds; more items are read in several passes.
BLOCK_WORDS = 500_000

# ASCII letters lower-cased, other letters and digits kept, all else a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
REPORT = "n_words bigint, hits array<struct<start:bigint,stop:bigint>>, items array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class SuffixAutomaton:
    """All runs of words of all items; ``length`` and ``link`` as usual, and which items hold a state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                numbered.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in numbered)], default=window)
        # By suffix links, each state's last one of at least a window's length, and from it on the next with short items.
        self.top, self.short = list(range(len(self.steps))), [0] * len(self.steps)
        by_length = sorted(range(1, len(self.steps)), key=self.length.__getitem__)
        for s in by_length:
            if self.length[self.link[s]] >= window:
                self.top[s] = self.top[self.link[s]]
        # Items of those last states, and short items by their own state.
        self.holders: dict[int, set[int]] = {}
        self.whole: dict[int, set[tuple[int, int]]] = {}
        for item, ids in numbered:
            state = 0
            for c in ids:
                state = self.steps[state][c]
                if self.length[state] >= window:
                    self.holders.setdefault(self.top[state], set()).add(item)
            if len(ids) < window:
                self.whole.setdefault(state, set()).add((len(ids), item))
        for s in by_length:
            self.short[s] = s if s in self.whole else self.short[self.link[s]]
        pairs = {(a, b) for _, ids in numbered for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(a * len(self.vocab) + b for a, b in pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        steps, link, length = self.steps, self.link, self.length
        if c in steps[last]:
            q = steps[last][c]
            return q if length[q] == length[last] + 1 else self._copy(last, c, q)
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, c, q)
        return new

    def _copy(self, p: int, c: int, q: int) -> int:
        copy = len(self.steps)
        self.steps.append(dict(self.steps[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, ids: list[int], base: int, hits: list[tuple[int, int]], items: set[int]) -> None:
        """Read known words; add hit ranges (from ``base`` on) and the items whose windows occur."""
        steps, link, length, window = self.steps, self.link, self.length, self.window
        top, short = self.top, self.short
        state = matched = 0
        for i, c in enumerate(ids, base + 1):
            while state and c not in steps[state]:
                state = link[state]
                matched = length[state]
            if c in steps[state]:
                state = steps[state][c]
                matched += 1
            if matched >= window:
                hits.append((i - window, i))
                items |= self.holders.get(top[state], set())
            if self.whole:
                at = short[state]
                while at > 0:
                    for n, item in self.whole[at]:
                        if n <= matched:
                            hits.append((i - n, i))
                            items.add(item)
                    at = short[link[at]]

    def read(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[int]]]:
        """Hit ranges (merged) and items of each list of words.

        A window is made of pairs of words that some item has, so only runs of such pairs,
        as long as the shortest window, are walked.
        """
        found = [([], set()) for _ in texts]
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in texts], out=starts[1:])
        get = self.vocab.get
        ids = np.full(int(starts[-1]) + 1, -1, dtype=np.int64)
        for words, start in zip(texts, starts):
            ids[start : start + len(words)] = [get(w, -1) for w in words]
        if self.shortest > 1 and len(self.pairs):
            near = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(near)
            codes = ids[at] * len(self.vocab) + ids[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            good = np.zeros(len(ids), dtype=np.int8)
            good[at[self.pairs[spot] == codes]] = 1
            extra = 1
        else:
            good, extra = (ids >= 0).astype(np.int8), 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good, [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a + extra >= self.shortest:
                doc = int(np.searchsorted(starts, a, side="right")) - 1
                self.walk(ids[a : b + extra].tolist(), int(a - starts[doc]), *found[doc])
        return [(merged(hits), sorted(items)) for hits, items in found]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def without_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of its words and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    kept, at = [], 0
    for start, stop in ranges:
        kept.append(raw[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with words, in blocks of at most about ``block_words`` words, one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if words and row["i"] is not None:
            block.append((row["i"], words))
            size += len(words)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _sent(automaton: SuffixAutomaton) -> bytes:
    """With its class, so that workers need no copy of this module."""
    return cloudpickle.dumps(automaton)


def _report(automaton) -> Callable[[Column], Column]:
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.int64())),
    ])

    def reported(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = cloudpickle.loads(automaton.value)
        for batch in texts:
            words = [words_of(t) for t in batch.to_pylist()]
            yield pa.array(
                [
                    {"n_words": len(w), "hits": [{"start": a, "stop": b} for a, b in hits], "items": items}
                    for w, (hits, items) in zip(words, machine.read(words))
                ],
                type=kind,
            )

    reported.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(reported, REPORT_TYPE).asNondeterministic()


REPORT_TYPE = f"struct<{REPORT.replace(' bigint', ':bigint').replace(' array', ':array')}>"


def merged_reports(left: Column, right: Column) -> Column:
    """Two reports on the same text by two automata, as one."""
    by_start = F.array_sort(F.concat(left["hits"], right["hits"]))
    first = F.slice(by_start, 1, 0)

    def add(done: Column, hit: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], hit["stop"]).alias("stop"))),
        )
        touches = (F.size(done) > 0) & (hit["start"] <= F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(touches, joined).otherwise(F.concat(done, F.array(hit)))

    return F.struct(
        left["n_words"].alias("n_words"),
        F.aggregate(by_start, first, add).alias("hits"),
        F.array_sort(F.array_union(left["items"], right["items"])).alias("items"),
    )


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    into: str = "report",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a struct ``into``: words, hit ranges of words, and items with occurring windows.

    Null and empty texts have no words and no hits.  Items without words or id are left out;
    repeated items change nothing.  Documents may repeat and have any other columns, which are kept; a column
    named ``into`` is replaced.  Without items nothing is hit.

    The items are read in blocks of bounded size, each sent to the executors as one
    automaton; every document meets every block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = item_blocks(benchmark, item_id, item_text, block_words)
    out, k = docs, 0
    for k, block in enumerate(blocks, 1):
        automaton = spark.sparkContext.broadcast(_sent(SuffixAutomaton(block, window)))
        report = _report(automaton)(F.col(text))
        if k == 1:
            out = out.withColumn(into, report)
        else:  # a step of its own for each further block: one automaton per worker
            more = unused(out, "more")
            out = stored(out, "contamination").withColumn(more, report)
            out = out.withColumn(into, merged_reports(F.col(into), F.col(more))).drop(more)
    if not k:
        empty = spark.sparkContext.broadcast(_sent(SuffixAutomaton([], window)))
        out = out.withColumn(into, _report(empty)(F.col(text)))
    return out


def n_hit(report: Column) -> Column:
    return F.aggregate(report["hits"], F.lit(0).cast("bigint"), lambda n, h: n + h["stop"] - h["start"])


def is_contaminated(report: Column, one_in: int = ONE_IN) -> Column:
    hit = n_hit(report)
    return (hit > 0) & (hit * one_in >= report["n_words"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", cut_spans: bool = False) -> DataFrame:
    """``docs`` without contaminated rows, or with ``cut_spans`` all rows, without the hit spans of those.

    Rows below the coverage limit stay as they are.
    """
    report, bad = unused(docs, "report"), unused(docs, "bad")
    read = with_hits(docs, benchmark, text, report).withColumn(bad, is_contaminated(F.col(report)))
    if not cut_spans:
        return read.where(~F.col(bad)).select(docs.columns)

    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array(
            [without_words(t, [(h["start"], h["stop"]) for h in hs]) if hs else t
             for t, hs in zip(texts.to_pylist(), hits.to_pylist())],
            type=pa.string(),
        )

    cut.__annotations__ = {"texts": pa.Array, "hits": pa.Array, "return": pa.Array}
    over = F.when(F.col(bad), F.col(report)["hits"])
    return read.withColumn(text, F.arrow_udf(cut, "string")(F.col(text), over)).select(docs.columns)
