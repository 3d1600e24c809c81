"""Secrets in texts: fixed patterns, and a linear-chain conditional random field beside them.

The field tags the words of a text as the begin, the inside or the outside of a secret, from
the shape of a word and its neighbours and from features of the whole text.  It learns from a
bounded sample in which the fixed patterns give the tags, and so finds words that look and
stand like secrets without the exact form.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import sent, small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The patterns of the kinds, in the order in which they are listed.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is what a run of any length is, if the shorter ones are dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "tagged")
LEAST_VALUE, LEAST_ACCESS = 6, 20

# The sample that the field learns from: documents read, and windows kept, at most about; half of these with secrets, half without.
SAMPLE_DOCUMENTS = 20_000
SAMPLE_WINDOWS = 3_000
WINDOW_WORDS = 12  # on either side
ODD_PER_DOCUMENT = 3
SECRETS_PER_DOCUMENT = 20  # of more, those of the least hash of their place
TRAINING_STEPS = 120

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"
KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key|credential|bearer|auth", re.IGNORECASE)
EDGES = "\"'`,;:!?()[]{}<>."


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# Features of a word, each a bit: its length, its letters and digits, its marks.
LENGTHS = (0, 1, 4, 8, 12, 16, 20, 24, 32, 48)
N_LENGTHS = len(LENGTHS)
MARKS = (
    "has_digit", "tenth_digits", "third_digits", "all_digits", "upper", "all_upper", "title", "lower",
    "letters_only", "letters_and_digits", "upper_lower_digit", "not_ascii", "equals", "colon", "quote", "key_marks",
    "dot", "at", "keyword", "ends_like_key", "hex_only", "changes_4", "changes_8", "akia", "phone_like", "number_like",
)
N_FEATURES = N_LENGTHS + len(MARKS)
FILE_FEATURES = ("any", "long", "lines", "equals", "odd_share", "base_keyword")


def word_bits(word: str) -> int:
    """The features of a word as the bits of a number."""
    n = len(word)
    bits = 1 << (sum(n >= x for x in LENGTHS) - 1)
    core = word.strip(EDGES)
    if core.isalpha() and core.islower():
        marks = (0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, not core.isascii(), 0, ":" in word, "'" in word or '"' in word,
                 0, "." in word, 0, bool(KEYWORD.search(core)), word[-1] in ":=", 0, 0, 0, 0, 0, 0)
    else:
        digits = sum(c.isdigit() for c in core)
        letters = sum(c.isalpha() for c in core)
        lower, upper = any(c.islower() for c in core), any(c.isupper() for c in core)
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
        marks = (
            digits > 0, 10 * digits >= n > 0, 3 * digits >= n > 0, digits == len(core) > 0, upper, upper and not lower,
            core.istitle(), lower, letters == len(core) > 0, digits > 0 and letters > 0, digits > 0 and lower and upper,
            not core.isascii(), "=" in word, ":" in word, "'" in word or '"' in word,
            any(c in "+/_-" for c in core), "." in core, "@" in word, bool(KEYWORD.search(word)), word[-1:] in (":", "="),
            len(core) >= 8 and all(c in "0123456789abcdef" for c in core), changes >= 4, changes >= 8,
            core.startswith("AKIA"), word[:1] in "+(" and digits > 0, digits > 0 and all(c in "0123456789.,:-" for c in core),
        )
    for k, on in enumerate(marks):
        if on:
            bits |= 1 << (N_LENGTHS + k)
    return bits


ODD = 1 << N_LENGTHS  # the bit "has_digit"


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Bits as a row of 0.0 and 1.0 per number."""
    return ((np.asarray(bits, dtype=np.int64)[..., None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def file_bits(text: str, n_words: int, n_odd: int) -> int:
    on = (
        True, n_words > 500, text.count("\n") * 20 > n_words, "=" in text, n_odd * 50 > n_words,
        bool(n_odd) and bool(KEYWORD.search(text)),
    )
    return sum(1 << k for k, x in enumerate(on) if x)


def unpacked_file(bits: np.ndarray) -> np.ndarray:
    return ((np.asarray(bits, dtype=np.int64)[..., None] >> np.arange(len(FILE_FEATURES))) & 1).astype(np.float64)


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def tags_of(places: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """The tag of each word under the fixed patterns: a word that a span touches is in it."""
    tags, k = [OUTSIDE] * len(places), 0
    for start, stop in merged([(a, b) for _, a, b in spans]):
        while k < len(places) and places[k][1] <= start:
            k += 1
        tag = BEGIN
        while k < len(places) and places[k][0] < stop:
            tags[k], tag = tag, INSIDE
            k += 1
    return tags


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def training_windows(text: str) -> list[dict]:
    """Windows of a text to learn from: around each secret, around some odd words, and one in its middle."""
    places = word_places(text)
    if not places:
        return []
    bits = [word_bits(text[a:b]) for a, b in places]
    tags = tags_of(places, base_spans(text))
    centres = [i for i, tag in enumerate(tags) if tag == BEGIN]
    if len(centres) > SECRETS_PER_DOCUMENT:
        centres = sorted(sorted(centres, key=lambda i: (zlib.crc32(b"%d" % i), i))[:SECRETS_PER_DOCUMENT])
    centres += [i for i, b in enumerate(bits) if b & ODD and tags[i] == OUTSIDE][:ODD_PER_DOCUMENT]
    if not centres:
        centres = [len(bits) // 2]
    about = file_bits(text, len(bits), sum(1 for b in bits if b & ODD))
    out = []
    for c in centres:
        a, b = max(0, c - WINDOW_WORDS), c + WINDOW_WORDS + 1
        out.append({
            "secret": any(t != OUTSIDE for t in tags[a:b]), "bits": [0, *bits][a : a + 1] + bits[a:b] + [*bits, 0][b : b + 1],
            "tags": tags[a:b], "about": about,
        })
    return out


@dataclass
class Field:
    """Weights of the features of a word and of its neighbours, of the text, and of tag pairs."""

    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    text: np.ndarray
    pairs: np.ndarray

    def slack(self) -> np.ndarray:
        """How much a tag other than OUTSIDE can gain through its neighbours' tags at most."""
        p = self.pairs
        gains = [
            [p[l, y] - p[l, OUTSIDE] + p[y, r] - p[OUTSIDE, r] for l in range(3) for r in range(3)] for y in range(3)
        ]
        return np.maximum(0, np.array(gains).max(axis=1))


def trained(windows: list[dict], steps: int = TRAINING_STEPS, penalty: float = 0.02) -> Field | None:
    """The weights of highest likelihood on tagged windows, less a penalty; None if no window has a secret."""
    windows = [w for w in windows if w["tags"]]
    if not any(w["secret"] for w in windows):
        return None
    n, most = len(windows), max(len(w["tags"]) for w in windows)
    bits = np.zeros((n, most + 2), dtype=np.int64)
    tags, inside = np.zeros((n, most), dtype=np.int64), np.zeros((n, most))
    about = unpacked_file(np.array([w["about"] for w in windows]))
    for i, w in enumerate(windows):
        size = len(w["tags"])
        row = w["bits"]
        bits[i, : len(row)] = row
        tags[i, :size], inside[i, :size] = w["tags"], 1
    one = unpacked(bits) * (bits > 0)[..., None]
    here = np.concatenate([one[:, 1:-1], one[:, :-2], one[:, 2:], np.repeat(about[:, None], most, axis=1)], axis=2)
    gold = np.eye(3)[tags] * inside[..., None]
    gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    weights, pairs = np.zeros((here.shape[2], 3)), np.zeros((3, 3))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    total = inside.sum()
    for step in range(1, steps + 1):
        marginal, pair_sum = _expectations(here @ weights, pairs, inside)
        slopes = (
            np.einsum("ntf,nty->fy", here, gold - marginal) / total - penalty * weights / 100,
            (gold_pairs - pair_sum) / total - penalty * pairs / 100,
        )
        for k, (value, slope) in enumerate(zip((weights, pairs), slopes)):  # Adam
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
            value += 0.15 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-9)
    f = N_FEATURES
    return Field(weights[:f], weights[f : 2 * f], weights[2 * f : 3 * f], weights[3 * f :], pairs)


def _expectations(scores: np.ndarray, pairs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag and tag-pair probabilities by the forward and backward recursions, for all windows at once."""
    n, most, _ = scores.shape
    scores = scores - scores.max(axis=2, keepdims=True)
    local, step = np.exp(scores), np.exp(pairs)
    forward, backward = np.zeros_like(local), np.ones_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, most):
        now = (forward[:, t - 1] @ step) * local[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        later = (local[:, t + 1] * backward[:, t + 1]) @ step.T
        later = later / later.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(inside[:, t + 1, None] > 0, later, 1.0)
    marginal = forward * backward
    marginal = marginal / marginal.sum(axis=2, keepdims=True) * inside[..., None]
    both = forward[:, :-1, :, None] * step[None, None] * (local[:, 1:] * backward[:, 1:])[:, :, None, :]
    both = both / both.sum(axis=(2, 3), keepdims=True) * inside[:, 1:, None, None]
    return marginal, both.sum(axis=(0, 1))


def viterbi(scores: np.ndarray, pairs: np.ndarray, left: int | None = None, right: int | None = None) -> list[int]:
    """The best tags of a run of words; ``left`` and ``right`` are the known tags beside it, if any."""
    best, back = scores[0] + (pairs[left] if left is not None else 0), []
    for row in scores[1:]:
        through = best[:, None] + pairs
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    if right is not None:
        best = best + pairs[:, right]
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


class Tagger:
    """Tags words of many texts at once.

    A word whose own score prefers OUTSIDE by more than its neighbours' tags can ever give is OUTSIDE in
    the best sequence, so the sequence falls apart there, and only what is left is decoded.
    """

    def __init__(self, field: Field):
        self.field = field
        self.kinds: dict[int, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.tables = np.zeros((1, 9))
        self.slack = field.slack()

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > 300_000:
            self.words = {"": 0}
        fresh = []
        for word in words.difference(self.words):
            bits = word_bits(word)
            if bits not in self.kinds:
                self.kinds[bits] = len(self.tables) + len(fresh)
                fresh.append(bits)
            self.words[word] = self.kinds[bits]
        if fresh:
            rows = unpacked(np.array(fresh))
            f = self.field
            self.tables = np.vstack([self.tables, np.hstack([rows @ f.here, rows @ f.before, rows @ f.after])])

    def tagged(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Ranges of words (begin, end) that the field tags as secrets, for each text."""
        lists = [t.split() for t in texts]
        flat = [w for ws in lists for w in (*ws, "")]
        try:
            kinds = np.array([self.words[w] for w in flat], dtype=np.int64)
        except KeyError:
            self._learn(set(flat))
            kinds = np.array([self.words[w] for w in flat], dtype=np.int64)
        sizes = np.array([len(ws) + 1 for ws in lists])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        odd_kinds = np.zeros(len(self.tables), dtype=bool)
        for bits, k in self.kinds.items():
            odd_kinds[k] = bool(bits & ODD)
        odd = np.add.reduceat(odd_kinds[kinds].astype(np.int64), starts[:-1]) if len(flat) else []
        about = [file_bits(t, len(ws), int(o)) for t, ws, o in zip(texts, lists, odd)]
        base = unpacked_file(np.array(about, dtype=np.int64)) @ self.field.text
        scores = self.tables[kinds, 0:3] + np.repeat(base, sizes, axis=0)
        scores[1:] += self.tables[kinds[:-1], 3:6]
        scores[:-1] += self.tables[kinds[1:], 6:9]
        margin = (scores[:, 1:] + self.slack[1:]).max(axis=1) - scores[:, OUTSIDE]
        open_words = (margin >= 0) & (kinds > 0)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_words.astype(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            first, last = int(starts[doc]), int(starts[doc + 1]) - 1
            tags = viterbi(
                scores[a:b], self.field.pairs, OUTSIDE if a > first else None, OUTSIDE if b < last else None
            )
            begin = None
            for i, tag in enumerate([*tags, OUTSIDE]):
                if begin is not None and tag != INSIDE:
                    out[doc].append((int(a) - first + begin, int(a) - first + i))
                    begin = None
                if tag == BEGIN or tag == INSIDE and begin is None:
                    begin = i
        return out


def spans_of(text: str, word_ranges: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """All spans of a text: the fixed patterns', and tagged words that touch none of those."""
    found = base_spans(text)
    if word_ranges:
        taken = merged([(a, b) for _, a, b in found])
        places = word_places(text)
        for first, last in word_ranges:
            start, stop = places[first][0], places[last - 1][1]
            while start < stop and text[start] in EDGES:
                start += 1
            while start < stop and text[stop - 1] in EDGES:
                stop -= 1
            if start < stop and not any(a < stop and start < b for a, b in taken):
                found.append(("tagged", start, stop))
    return in_order(found)


def learned(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> Field | None:
    """A field that has learned from about ``documents`` texts, chosen by hash, tagged by the fixed patterns.

    At most ``windows`` windows reach the driver, half of them with secrets, at most about ``SECRETS_PER_DOCUMENT`` from one text.
    """
    small_batches(docs.sparkSession)
    total = docs.count()
    share = min(1.0, documents / max(1, total))
    kind = pa.list_(pa.struct([
        ("secret", pa.bool_()), ("bits", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("about", pa.int64()),
    ]))

    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([training_windows(t) if t else [] for t in batch.to_pylist()], type=kind)

    cut.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    cut_udf = F.arrow_udf(
        cut, "array<struct<secret:boolean,bits:array<bigint>,tags:array<bigint>,about:bigint>>"
    ).asNondeterministic()
    hashed = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    chosen = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])
    every = stored(chosen.select("h", F.posexplode(cut_udf(F.col("t"))).alias("p", "w")), "secret-windows")
    # Windows with secrets and windows without have a share each, whatever their numbers; both go by hash.
    rows = [
        row for has_secret in (True, False)
        for row in every.where(F.col("w.secret") == has_secret).orderBy("h", "p").limit(windows // 2).collect()
    ]
    return trained([r["w"].asDict() for r in sorted(rows, key=lambda r: (r["h"], r["p"]))])


def found_secrets(spark, field: Field | None, text: Column) -> Column:
    """The spans of each whole text, as an array of (kind, start, stop) in code points, end exclusive.

    Null and empty texts have none.  Without a field only the fixed patterns count.
    """
    packed = sent(spark, field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = cloudpickle.loads(packed.value)
        tagger = Tagger(known) if known is not None else None
        for batch in texts:
            whole = [t or "" for t in batch.to_pylist()]
            ranges = tagger.tagged(whole) if tagger and whole else [[] for _ in whole]
            yield pa.array(
                [[{"kind": k, "start": a, "stop": b} for k, a, b in spans_of(t, r)] for t, r in zip(whole, ranges)], type=kind
            )

    scanned.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scanned, SPANS).asNondeterministic()(text)


def with_secrets(docs: DataFrame, field: Field | None, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array ``into`` of spans; rows and other columns stay (a column ``into`` is replaced)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, found_secrets(docs.sparkSession, field, F.col(text)))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mask``; overlapping spans are one."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), found.to_pylist()):
            for a, b in reversed(merged([(s["start"], s["stop"]) for s in spans or []])):
                t = t[:a] + mask + t[b:]
            out.append(t)
        return pa.array(out, type=pa.string())

    cut.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.when(F.size(spans) > 0, F.arrow_udf(cut, "string")(text, spans)).otherwise(text)
