"""Language identification with string kernels.

The kernel of two texts counts the n-grams of one to three characters that both hold
(presence, not frequency), over the root of the product of how many each holds.  A bounded sample of
labelled texts gives landmarks; every text is described by its kernel with the landmarks
(Nystroem), and one ridge regression per language, against the rest, scores it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import in_fold, sent, small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
HELD_OUT = (4, 2)  # a document whose folded id leaves 2 of 4 teaches nothing
LONGEST_GRAM = 3
LANDMARKS_PER_LANGUAGE = 32
SAMPLE_PER_LANGUAGE = 600
RIDGE = 1e-3
GUESS = "struct<lang:string,score:double>"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def gram_codes(text: str | None) -> np.ndarray:
    """The distinct n-grams of the text's letters and word borders, as sorted numbers.

    A character takes 21 bits of a number, so no two n-grams share one.
    """
    # Number letters such as Ⅷ and ² stand beside letters only.
    folded = NOT_LETTERS.sub(" ", text.lower()).strip() if text and any(map(str.isalpha, text)) else ""
    if not folded:
        return np.empty(0, dtype=np.int64)
    chars = np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
    grams, codes = [], np.zeros(len(chars), dtype=np.int64)
    for n in range(LONGEST_GRAM):
        codes = (codes[: len(chars) - n] << 21) | chars[n:]
        grams.append(codes)
    every = np.concatenate(grams)
    every.sort()
    keep = np.empty(len(every), dtype=bool)
    keep[0] = True
    np.not_equal(every[1:], every[:-1], out=keep[1:])
    return every[keep]


@dataclass
class Landmarks:
    """Which n-grams which landmark text holds."""

    codes: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    holds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.uint8))

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Landmarks:
        texts = [t for t in texts if len(t)]
        if not texts:
            return cls()
        codes = np.unique(np.concatenate(texts))
        holds = np.zeros((len(codes), len(texts)), dtype=np.uint8)
        for j, grams in enumerate(texts):
            holds[np.searchsorted(codes, grams), j] = 1
        return cls(codes, holds)

    def kernel(self, texts: list[np.ndarray], holds: np.ndarray | None = None) -> np.ndarray:
        """One row per text: its kernel with every landmark, by one matrix product."""
        holds = self.holds.astype(np.float32) if holds is None else holds
        present = np.zeros((len(texts), len(self.codes)), dtype=np.float32)
        for i, grams in enumerate(texts):
            if len(grams) and len(self.codes):
                at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
                present[i, at[self.codes[at] == grams]] = 1
        sizes = np.array([max(1, len(grams)) for grams in texts], dtype=np.float64)
        own = np.maximum(1, self.holds.sum(axis=0, dtype=np.int64))
        return (present @ holds).astype(np.float64) / np.sqrt(sizes[:, None] * own[None, :])


@dataclass
class LanguageModel:
    landmarks: Landmarks
    languages: list[str]
    weights: np.ndarray  # landmarks by languages

    def scores(self, texts: list[np.ndarray], holds: np.ndarray | None = None) -> np.ndarray:
        return self.landmarks.kernel(texts, holds) @ self.weights


def fitted(landmarks: Landmarks, kernels: np.ndarray, labels: list[str], ridge: float = RIDGE) -> LanguageModel:
    """One ridge regression per language on the Nystroem features of the labelled rows."""
    languages = sorted(set(labels))
    own = np.zeros((landmarks.holds.shape[1],) * 2)
    if own.size:
        counts = landmarks.holds.astype(np.float64)
        sizes = np.maximum(1, counts.sum(axis=0))
        own = counts.T @ counts / np.sqrt(sizes[:, None] * sizes[None, :])
    values, vectors = np.linalg.eigh(own) if own.size else (np.empty(0), own)
    keep = values > 1e-6
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    features = kernels @ to_features
    targets = np.array([[float(label == lang) for lang in languages] for label in labels])
    gram = features.T @ features + ridge * max(1, len(labels)) * np.eye(features.shape[1])
    return LanguageModel(landmarks, languages, to_features @ np.linalg.solve(gram, features.T @ targets))


def _udf(function, result: str, *kinds) -> object:
    function.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(function, result).asNondeterministic()


def _grams(text: Column) -> Column:
    def grams(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([gram_codes(t) for t in batch.to_pylist()], type=pa.list_(pa.int64()))

    return _udf(grams, "array<bigint>")(text)


def _kernels(landmarks) -> object:
    def kernels(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = cloudpickle.loads(landmarks.value)
        holds = marks.holds.astype(np.float32)
        for batch in texts:
            rows = marks.kernel([gram_codes(t) for t in batch.to_pylist()], holds)
            yield pa.array(list(rows), type=pa.list_(pa.float64()))

    return _udf(kernels, "array<double>")


def sample_of(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows (doc_id, text, lang) of each language, those with the lowest hash.

    The hashes are ranked without the texts, which then are read in place for the chosen rows alone, and ranked again, as
    repeated rows share a hash.  Of a frequent language only the lower hashes are ranked, about
    four times as many as are wanted.  What is sent to all tasks is one row per language, of which the model
    holds a column each anyway.
    """
    spark = labelled.sparkSession
    ranked = Window.partitionBy("lang").orderBy("h", "doc_id")
    hashed = labelled.withColumn("h", F.xxhash64("doc_id"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    known = spark.createDataFrame(counts, "lang string, n bigint")
    low = F.shiftrightunsigned("h", 11) < F.least(F.lit(1.0), 4.0 * per_language / F.col("n")) * F.lit(2.0**53)
    bars = (
        hashed.select("lang", "doc_id", "h").join(F.broadcast(known), "lang").where(low)
        .withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= per_language)
        .groupBy("lang").agg(F.max("h").alias("bar"), F.max("n").alias("n")).collect()
    )
    known = spark.createDataFrame(bars, "lang string, bar bigint, n bigint")
    return (
        hashed.join(F.broadcast(known), "lang").where(low & (F.col("h") <= F.col("bar")))
        .withColumn("r", F.row_number().over(ranked))
        .where(F.col("r") <= per_language).select("doc_id", "text", "lang", "r")
    )


def learned(
    docs: DataFrame,
    per_language: int = SAMPLE_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
    folds: tuple[int, int] | None = HELD_OUT,
) -> LanguageModel:
    """A model of the labelled rows of ``docs(doc_id, text, lang)`` outside the held-out fold.

    The sample is bounded by ``per_language`` rows a language and only numbers reach the driver: the
    n-grams of the landmarks and the sample's kernels with them.  Without labelled rows there are
    no languages.
    """
    spark = docs.sparkSession
    small_batches(spark, 128)
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if folds:
        labelled = labelled.where(~in_fold(F.col("doc_id"), *folds))
    sample = stored(sample_of(labelled, per_language), "language-sample")
    marks = sample.where(F.col("r") <= landmarks_per_language).select("lang", "r", _grams(F.col("text")).alias("grams"))
    landmarks = Landmarks.of(
        [np.array(row["grams"], dtype=np.int64) for row in sorted(marks.collect(), key=lambda x: (x["lang"], x["r"]))]
    )
    rows = sample.select("lang", "doc_id", "r", _kernels(sent(spark, landmarks))(F.col("text")).alias("k")).collect()
    rows.sort(key=lambda x: (x["lang"], x["r"]))
    kernels = np.array([r["k"] for r in rows]).reshape(len(rows), landmarks.holds.shape[1])
    return fitted(landmarks, kernels, [r["lang"] for r in rows])


def guess(spark, model: LanguageModel, text: Column) -> Column:
    """The language of each whole text and its score from 0 to 1, as a struct ``lang, score``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned.
    """
    packed = sent(spark, model)

    def guessed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = cloudpickle.loads(packed.value)
        holds = model.landmarks.holds.astype(np.float32)
        for batch in texts:
            grams = [gram_codes(t) for t in batch.to_pylist()]
            known = [i for i, g in enumerate(grams) if len(g) and model.languages]
            langs, scores = [UNKNOWN] * len(grams), np.zeros(len(grams))
            if known:
                rows = model.scores([grams[i] for i in known], holds)
                for i, row in zip(known, rows):
                    best = int(np.argmax(row))
                    langs[i], scores[i] = model.languages[best], min(1.0, max(0.0, float(row[best])))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return _udf(guessed, GUESS)(text)


def has_letter(text: Column) -> Column:
    """True for texts with a letter, in any script."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "guess") -> DataFrame:
    """``docs`` with a struct ``into``; rows and other columns stay as they are (a column ``into`` is replaced)."""
    small_batches(docs.sparkSession, 128)
    return docs.withColumn(into, guess(docs.sparkSession, model, F.col(text)))
