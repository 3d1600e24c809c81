"""Spelling variants: pairs of words one edit apart, by composing acceptors with a one-edit transducer.

Two words are one edit apart if a transducer that copies letters, changes or leaves out exactly one,
and copies on takes one to the other.  The vocabulary's acceptor, that transducer and the acceptor again,
composed, accept the pairs.  The composed machine is cut into partitions by its initial state: the words of a
partition share all letters outside a stretch in which the edit lies, so a partition is a state that the letters
before have led to, and its acceptors hold the letters of the stretch alone.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Code points of a word at least, and its occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
# A form is so many times as frequent as the word.
TIMES = 10
# One in so many words of a document, by hash, loses a letter.
FAULT_ONE_IN = 31
# Words of a partition at most; a larger one is cut in two until it is small.  A stretch of
# one letter has no more words than there are letters, so the cutting comes to an end.
MOST_WORDS = 20_000
# Distinct words that a task counts, and rows of results it holds, before it hands them on.
WORDS_HELD, ROWS_HELD = 300_000, 20_000

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = "a-zÀ-ÿ"


def counted_words(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    fault_one_in: int = FAULT_ONE_IN,
) -> DataFrame:
    """``word, n``: words of all texts with their occurrences.

    A run of letters (A-Z lower-cased) whose CRC-32 after ``<doc_id>:`` (nothing before the colon for a null id)
    is divisible by ``fault_one_in`` loses the code point at that number modulo its length.
    """
    # A shorter run cannot become a longer one.
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = value.as_py()
                if not whole:
                    continue
                found = runs.findall(whole.encode("utf-8", "surrogatepass").translate(LOWERED).decode("utf-8", "surrogatepass"))
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % fault_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    seen[word] += n
                if len(seen) >= WORDS_HELD:
                    yield from handed_on(seen)
        yield from handed_on(seen)

    def handed_on(seen: Counter) -> Iterator[pa.RecordBatch]:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"]
        )
        seen.clear()
        for at in range(0, batch.num_rows, ROWS_HELD):
            yield batch.slice(at, ROWS_HELD)

    small_batches(docs.sparkSession)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal automaton of some sorted distinct strings: state 0 begins, ``arcs`` by letter, ``final``."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(upto: int) -> None:
            """Give the states of the last string below ``upto`` letters their final number."""
            for at in range(len(last), upto, -1):
                state = path.pop()
                form = (self.final[state], tuple(self.arcs[state].items()))
                same = known.setdefault(form, state)
                if same != state:
                    self.arcs[path[-1]][last[at - 1]] = same

        for string in strings:
            most = min(len(last), len(string))
            shared = next((i for i in range(most) if last[i] != string[i]), most)
            settle(shared)
            for letter in string[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = string
        settle(0)


def both_accept(one: Acceptor, p: int, other: Acceptor, r: int, not_first: str | None = None) -> Iterator[str]:
    """Strings that lead from ``p`` in one and from ``r`` in the other to a final state, none that begins with ``not_first``."""
    path: list[str] = []
    stack = [(p, r, 0, "")]
    while stack:
        p, r, depth, letter = stack.pop()
        if depth:
            path[depth - 1 :] = [letter]
        if one.final[p] and other.final[r]:
            yield "".join(path)
        left, right = one.arcs[p], other.arcs[r]
        for c in left if len(left) <= len(right) else right:
            if c in left and c in right and not (depth == 0 and c == not_first):
                stack.append((left[c], right[c], depth + 1, c))


def one_edit_pairs(longer: Acceptor, shorter: Acceptor | None, follows: str = "") -> Iterator[tuple[str, str]]:
    """Pairs that the composed machine accepts: of two ``longer`` strings, or a longer and a ``shorter`` one, once each.

    While nothing has been edited both sides have read the same, so a state of the composition is a
    state of either acceptor.  The edit comes where the two first differ: a letter changed into a later
    one, or a letter left out that does not come next on the other side.  All strings are followed by ``follows``.
    """
    path: list[str] = []
    stack: list[tuple[int, int, int, str]] = [(0, 0 if shorter else -1, 0, "")]
    while stack:
        q, s, depth, letter = stack.pop()
        if depth:
            path[depth - 1 :] = [letter]
        arcs = longer.arcs[q]
        choices = list(arcs.items())
        so_far = None
        for i, (c, p) in enumerate(choices):
            for d, r in choices[:i]:
                for rest in both_accept(longer, p, longer, r):
                    so_far = "".join(path) if so_far is None else so_far
                    yield so_far + c + rest, so_far + d + rest
            if s >= 0:
                for rest in both_accept(longer, p, shorter, s, not_first=c):
                    if not rest and c == follows:
                        continue
                    so_far = "".join(path) if so_far is None else so_far
                    yield so_far + c + rest, so_far + rest
        for c, p in choices:
            stack.append((p, shorter.arcs[s].get(c, -1) if s >= 0 else -1, depth + 1, c))


def near_of_partition(words: list[tuple[str, int]], longest: int, start: int, stop: int) -> Iterator[tuple[str, int, int, str]]:
    """``word, n_near, best_n, best``: what a partition adds to each of its words that has a near one in it.

    The words have ``longest`` letters or one less, and are alike in the first ``start`` letters and
    in those after ``stop`` of the longest.
    """
    after = longest - stop
    by_ends: dict[tuple[str, str], list[tuple[str, str, int]]] = {}
    for word, n in words:
        cut = len(word) - after
        by_ends.setdefault((word[:start], word[cut:]), []).append((word[start:cut], word, n))
    for (_, tail), alike in by_ends.items():
        longer = sorted(w for w, _, _ in alike if len(w) == stop - start)
        if not longer or len(alike) < 2:
            continue
        shorter = sorted(w for w, _, _ in alike if len(w) < stop - start)
        whole = {stretch: (word, n) for stretch, word, n in alike}
        best: dict[str, list] = {}
        for a, b in one_edit_pairs(Acceptor(longer), Acceptor(shorter) if shorter else None, tail[:1]):
            for one, other in ((a, b), (b, a)):
                word, n = whole[other]
                entry = best.setdefault(one, [0, n, word])
                entry[0] += 1
                if n > entry[1] or n == entry[1] and word < entry[2]:
                    entry[1:] = n, word
        for stretch, (n_near, best_n, best_word) in best.items():
            yield whole[stretch][0], n_near, best_n, best_word


def _placed(words: DataFrame, stretches: Column) -> DataFrame:
    """Words with a partition for each of some ``(longest, start, stop)``; words of a partition have the same key."""
    every = words.select("word", "n", F.explode(stretches).alias("at")).select("word", "n", "at.*")
    ends = F.expr("substring(word, 1, start)"), F.expr("right(word, longest - stop)")
    return every.withColumn("key", F.xxhash64("longest", "start", "stop", *ends))


def partitions(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``word, n, longest, start, stop, key``: every word in all partitions it takes part in.

    A word is the longer or equal one of pairs of its own length, and the shorter one of pairs whose longer has a
    letter more.  For each of the two the edit is in the first or in the second half.  A partition with too many words
    is cut: in each half of its stretch the words share the letters of the other half as well.
    """

    def stretch(longest: Column, start: Column, stop: Column) -> Column:
        return F.struct(longest.alias("longest"), start.alias("start"), stop.alias("stop"))

    def halves(longest: Column, start: Column, stop: Column) -> list[Column]:
        middle = ((start + stop) / 2).cast("int")
        return [stretch(longest, start, middle), stretch(longest, middle, stop)]

    length = F.length("word")
    rows = _placed(words, F.array(*(h for m in (length, length + 1) for h in halves(m, F.lit(0), m))))
    small = None
    while True:
        rows = stored(rows, "spelling-partitions")
        large = rows.groupBy("key").agg(F.count("*").alias("rows")).where((F.col("rows") > most_words)).select("key")
        large = stored(large, "spelling-large")
        none = large.isEmpty()
        kept = rows if none else rows.join(large, "key", "left_anti")
        small = kept if small is None else small.unionByName(kept)
        if none:
            return small
        # Only partitions with more than one letter can be large.
        rows = _placed(
            rows.join(large, "key", "left_semi").withColumn("cut", F.array(*halves(*map(F.col, ("longest", "start", "stop"))))),
            F.col("cut"),
        )


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: for every word with a near one, how many, and the most frequent (ties: the first)."""
    placed = partitions(words, max(most_words, 1_000))
    placed = placed.repartition("key").sortWithinPartitions("key").select("key", "longest", "start", "stop", "word", "n")
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for table in _whole_keys(batches):
            keys = table.column("key").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            # A word alone has nobody to pair with.
            several = np.flatnonzero(np.diff(edges) > 1)
            if not len(several):
                continue
            longest, start, stop = (table.column(c).to_numpy() for c in ("longest", "start", "stop"))
            word, n = table.column("word").to_pylist(), table.column("n").to_pylist()
            for at in several:
                a, b = int(edges[at]), int(edges[at + 1])
                by_place: dict[tuple, list] = {}
                for k in range(a, b):
                    by_place.setdefault((int(longest[k]), int(start[k]), int(stop[k])), []).append((word[k], n[k]))
                for place, alike in by_place.items():
                    out.extend(near_of_partition(alike, *place))
                if len(out) >= ROWS_HELD:
                    yield handed_on()
        if out:
            yield handed_on()

    found = placed.mapInArrow(compose, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best"))
    together = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return together.select("word", "n_near", (-F.col("top.rank")).alias("best_n"), F.col("top.best").alias("best"))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in tables that do not cut a key in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[-1].column(0)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if last or held:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of stored ``word, form``: the last word that the forms lead to, for words that have one.

    A form is more frequent than its word, so forms never lead back.  Each step doubles how far a root reaches.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        roots = stored(roots, "spelling-roots")


def grouped_words(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    fault_one_in: int = FAULT_ONE_IN,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the texts.

    ``n_near`` counts the words one edit away.  ``form`` is the most frequent of them (ties: the first in code-point order) if it
    occurs at least ``times`` as often as the word, else null; ``root`` is where forms end.  Null, empty and letterless
    texts have no words; a very long text and a very long word are taken whole; repeated rows count each time; other columns are
    not read; an empty table gives no rows.
    """
    words = stored(counted_words(docs, text, doc_id, least_length, least_count, fault_one_in), "spelling-words")
    far = F.col("best_n") >= times * F.col("n")
    known = words.join(near_words(words, most_words), "word", "left").select(
        "word",
        F.when(far, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(far, F.col("best_n")).alias("form_n"),
    )
    known = stored(known, "spelling-forms")
    roots = with_roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
