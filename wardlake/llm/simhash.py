"""Near-duplicates by SimHash fingerprints, found through the perfect binary Golay code.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits.  If two
fingerprints differ in at most two bits, some segment is the same in both, and the one after it differs in two
bits at most.  Any two words of 23 bits that differ in at most two bits have a codeword within
four bits of both, and a word has one or six such codewords.  So the equal segment with the number of
a codeword near the next one is a key that both fingerprints have, among 18 at most.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import small_batches, stored, unused
from wardlake.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
# Fingerprints of one key that are compared pair by pair.
SMALL_BUCKET = 32


def fingerprint(text: str | None) -> int:
    """The SimHash of the text's word shingles, unsigned; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(SHINGLE_WORDS))) if len(words) >= SHINGLE_WORDS else [words]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    hashes = np.array([digest(b" ".join(run), SEED) for run in runs], dtype="<u8")
    for at in range(0, len(hashes), 50_000):  # very long texts in parts
        part = hashes[at : at + 50_000]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long of the same bits."""

    def prints(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t) for t in texts.to_pylist()], dtype="<u8")
        return pa.array(values.view("<i8"))

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    small_batches(docs.sparkSession)
    return docs.withColumn(into, F.arrow_udf(prints, "bigint").asNondeterministic()(F.col(text)))


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator: zero for codewords."""
    rest = words.astype(np.int64)
    for k in range(22, 10, -1):
        rest = rest ^ (((rest >> k) & 1) * (GENERATOR << (k - 11)))
    return rest


def near_patterns() -> np.ndarray:
    """For each remainder the error patterns of at most four bits that leave it: one or six, then -1."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for pattern, rest in zip(patterns, syndromes(patterns)):
            table[rest, used[rest]] = pattern
            used[rest] += 1
    return table


def near_codewords(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The numbers (12 leading bits) of the codewords within four bits of each word; -1 where there is none."""
    patterns = table[syndromes(words)]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


def keys_of(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, 18 columns, -1 where there is none."""
    prints = prints.astype(np.int64).view(np.uint64)
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    columns = []
    for k, part in enumerate(parts):
        near = near_codewords(parts[(k + 1) % 3], table)
        columns.append(np.where(near >= 0, (((k << 22) | part)[:, None] << 12) | near, -1))
    return np.hstack(columns)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (column ``fp``, distinct) of at most two bits' distance.

    In a key's bucket of up to 32 fingerprints each is compared with those before it.  Members of larger buckets
    are linked through midpoints instead: two fingerprints differ in at most two
    bits exactly if some word is within one bit of both.  A midpoint has 65 such fingerprints at most, and
    they are linked to the least of them.  So work grows with the number of fingerprints, however alike they are.
    """
    table = near_patterns()

    def keyed(values: pa.Array) -> pa.Array:
        keys = keys_of(values.to_numpy(zero_copy_only=False), table)
        return pa.array([row[row >= 0] for row in keys], type=pa.list_(pa.int64()))

    keyed.__annotations__ = {"values": pa.Array, "return": pa.Array}
    keys = prints.select("fp", F.explode(F.arrow_udf(keyed, "array<bigint>")(F.col("fp"))).alias("key"))
    bucket = Window.partitionBy("key")
    shared = stored(keys.withColumn("n", F.count("*").over(bucket)).where("n > 1"), "simhash-buckets")
    before = F.collect_list("fp").over(bucket.orderBy("fp").rowsBetween(1 - SMALL_BUCKET, -1))
    pairs = shared.where(F.col("n") <= SMALL_BUCKET).select("fp", before.alias("others"))
    near = F.filter("others", lambda o: F.bit_count(o.bitwiseXOR(F.col("fp"))) <= MOST_BITS)
    linked = pairs.select(F.col("fp").alias("a"), F.explode(near).alias("b"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    crowded = shared.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    around = crowded.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("midpoint"))
    stars = around.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("midpoint")).alias("b"))
    return linked.union(stars.where("a != b")).distinct()


def rooted(prints: DataFrame) -> DataFrame:
    """``fp, root, least`` of the fingerprints of rows ``doc_id, fp``: the fingerprint that names the group, and the least id of each."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(fingerprint_links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    return nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the least id reachable over links of at most two bits, the document's own included.
    Texts without words share fingerprint zero and are linked like any others.  Texts of any length are read whole.  Rows
    with a null id are grouped too, but give no component id; repeated rows stay.  Other columns are not read, whatever their names.
    An empty table gives no rows.
    Documents of one fingerprint are one node with their least id, so copies cost
    nothing but their own rows.
    """
    prints = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash")
    of_root = rooted(prints)
    least = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = of_root.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: of the least id (null after all others), then of the least SHA-256 of the text.

    Ids need be neither unique nor there: every group keeps a text of its own.  Of rows that are
    alike in id and text one stays.  A null text is empty.  Columns stay as they are; an empty table stays empty.
    """
    n, digest, key, own = (unused(docs, name) for name in ("n_rows", "digest", "key", "own_digest"))
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    prints = with_fingerprint(marked.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(own).alias("digest")))
    prints = stored(prints.select("doc_id", "fp", "digest"), "simhash")
    alike = prints.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = alike.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("first"))
    chosen = rooted(prints).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = chosen.select(F.col("first.doc_id").alias(key), F.col("first.digest").alias(digest), F.col("first.n").alias(n))
    kept = marked.join(keep, (F.col(own) == F.col(digest)) & F.col(doc_id).eqNullSafe(F.col(key)))
    once = kept.where(F.col(n) == 1).select(docs.columns)
    # Only rows that repeat need to be brought together.
    again = kept.where(F.col(n) > 1).dropDuplicates([digest, key]).select(docs.columns)
    return once.unionByName(again)
