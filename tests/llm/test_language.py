import zlib

import numpy as np
from pyspark.sql import functions as F

from wardlake.llm import language
from wardlake.llm.queries import op1_language_id


def grams(text):
    folded = language.NOT_LETTERS.sub(" ", text.lower()).strip()
    folded = f" {folded} "
    return {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}


def test_codes_are_the_distinct_grams(texts):
    for _, text, _ in texts:
        if text and len(text) < 5000 and any(c.isalpha() for c in text):
            assert len(language.gram_codes(text)) == len(grams(text))


def test_kernel_is_the_share_of_common_grams(texts):
    some = [t for _, t, _ in texts[:20]]
    codes = [language.gram_codes(t) for t in some]
    rows = language.Landmarks.of(codes[:7]).kernel(codes)
    for i, a in enumerate(some):
        for j, b in enumerate(some[:7]):
            want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert abs(rows[i, j] - want) < 1e-6


def test_every_row_gets_a_language(spark, docs, texts):
    model = language.learned(docs)
    found = language.with_language(docs, model, into="found")
    rows = found.select("text", "guess", F.col("found.lang").alias("said"), "found.score").collect()
    assert len(rows) == len(texts)
    for row in rows:
        if row["text"] is None or not any(c.isalpha() for c in row["text"]):
            assert (row["said"], row["score"]) == ("und", 0.0)
        else:
            assert row["said"] in model.languages and 0 <= row["score"] <= 1
        assert row["guess"] == "g"


def test_nothing_learned_from_an_empty_table(docs, no_docs):
    model = language.learned(no_docs)
    assert model.languages == []
    assert {r[0] for r in language.with_language(docs, model).select("guess.lang").collect()} == {"und"}
    assert language.with_language(no_docs, model).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    guessed = op1_language_id(spark, sf_dir)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = guessed.join(given, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
