"""The documents' way into training: known languages, one of each group, no test items, no secrets, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import contamination, language, packing, secret_scan, simhash
from wardlake.llm.common import stored, table, unused
from wardlake.llm.queries import tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts and texts without a letter go.

    A text with a letter gets a language whatever its score, and stays; so do all of them where no row is labelled, or only rows of
    the held-out fold.  Ids may repeat or be null, texts may be of any length, columns of any name stay; an empty table stays empty.
    """
    model = language.learned(docs)
    if not model.languages:
        return docs.where(language.has_letter(F.col("text")))
    guess = unused(docs, "guess")
    guessed = language.with_language(docs, model, into=guess)
    return guessed.where(F.col(guess)["lang"] != language.UNKNOWN).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id; a repeated or null id costs no text (see ``deduplicated``)."""
    return simhash.deduplicated(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; one with a few hit words stays as it is."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and their number of characters counted anew."""
    spans = unused(docs, "spans")
    found = secret_scan.with_secrets(docs, secret_scan.learned(docs), into=spans)
    found = found.withColumn("text", secret_scan.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(docs, tokenizer(packing.TOKENIZER))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

# The stages learn models and hash words: SQL cannot express them.  The tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
