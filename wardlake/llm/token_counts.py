"""Token counts of whole texts: pieces counted once per distinct pre-token, then joined and summed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm import pretokens
from wardlake.llm.chunked import chunked, entries, summed
from wardlake.llm.common import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def piece_counts(entries: DataFrame, tokenizer_path: str) -> DataFrame:
    """``ref, number`` for every entry ``word, ref``: how many tokens the word becomes.

    Entries of the same word meet in one partition, one after the other; its tokens are counted at the first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pretokens.Pieces(pretokens.load(tokenizer_path))
        last, last_number = None, 0
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            fresh = distinct[1:] if distinct[:1] == [last] else distinct
            numbers = [len(pieces(word)) for word in fresh]
            if len(fresh) < len(distinct):
                numbers = [last_number, *numbers]
            if distinct:
                last, last_number = distinct[-1], numbers[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(numbers, pa.int64()).take(words.indices)], names=["ref", "number"]
            )

    met = entries.repartition("word").sortWithinPartitions("word")
    return met.mapInArrow(count, "ref bigint, number bigint")


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens``.

    A null text counts as empty: no bytes, no tokens.  Special strings inside a text count one each, as the
    library does by default.  Rows may repeat; other columns are not read; an empty table gives no rows.
    """

    def cutter():
        whole = pretokens.load(tokenizer_path)

        def cut(text: str | None) -> tuple[list[str], dict]:
            words, specials = pretokens.byte_pretokens(whole, text)
            n_bytes = len(text.encode("utf-8", "surrogatepass")) if text else 0
            return words, {"n_bytes": n_bytes, "specials": specials}

        return cut

    extra = {"n_bytes": "bigint", "specials": "bigint"}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("weight"))
    chunks = chunked(rows, cutter, extra)
    numbers = piece_counts(entries(chunks), tokenizer_path)
    added = summed(chunks, numbers, lambda n: [n], {"n_pieces": "bigint"}, extra)
    small_batches(docs.sparkSession, 10_000, 8 << 20)
    return added.select("doc_id", "n_bytes", (F.col("n_pieces") + F.col("specials")).alias("n_tokens"))
