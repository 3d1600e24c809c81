"""URL rules: host suffixes and path prefixes of every URL, looked up by the start of their digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.common import LOWER, UPPER

PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
# What a URL without a rule gets.
DEFAULT_VERDICT = "allow"
# A host and path head with more than this share of all pages is frequent: there are fewer of them than its inverse.
FREQUENT = 1e-3
# Hexadecimal digits of a digest that the join compares.
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.

    Empty for null and for a text without ``://``.
    """
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # No host holds a slash, so host and path cannot be cut differently.
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judged_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule fits its own host and all subdomains, if the path starts with the rule's.  Of
    several, the one with the longest text (host and path) wins, then the longest host; of the same rule
    given twice with two verdicts, ``block`` wins.  Without a rule ``rule`` is null and the
    verdict is ``default``.  A null URL and one without ``://`` have an empty host and path,
    which only a rule with an empty host and path fits.  Repeated pages stay repeated; an empty table of pages or rules
    gives no rows, or no matches; other columns of either table are not read.

    Every pair of host and path head is expanded once, however many pages share it: its host suffixes
    times its path prefixes, cut at the lengths that rules have; of a long host only suffixes of as many labels as rules have.  The expressions meet the
    rules on the first digits of their SHA-256 and are confirmed on the whole digest.
    """
    known = (
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.col("path").alias("path"), "verdict"
        )
        .where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_length"),
            "verdict",
            F.length("path").alias("path_length"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        )
        .withColumn("key", F.substring("rule_digest", 1, KEY_DIGITS))
    )
    # The lengths that paths of rules have, and their hosts' numbers of labels: few, as URLs are short.
    shapes = known.select("path_length", "labels").distinct().collect()
    lengths = sorted({row["path_length"] for row in shapes})
    longest, most_labels = max(lengths, default=0), max((row["labels"] for row in shapes), default=1)
    parts = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("head", F.substring("path", 1, longest) if longest else F.lit(""))
    labels = F.split("host", r"\.", -1)
    # No suffix of more labels than a rule has can be one of a rule.
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("head"))
    heads = parts.groupBy("host", "head").agg(F.count("*").alias("n"))
    expressions = (
        heads.select("host", "head", F.explode(suffixes).alias("suffix"))
        .select("host", "head", "suffix", F.explode(cuts).alias("cut"))
        .select("host", "head", _digest(F.col("suffix"), F.expr("substring(head, 1, cut)")).alias("digest"))
        .withColumn("key", F.substring("digest", 1, KEY_DIGITS))
    )
    best = (
        expressions.join(known, "key")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "head")
        .agg(F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("best"))
    )
    # A third of all pages may be of one host: pages of frequent ones meet their rule where they are, and are not shuffled.
    place = ["host", "head"]
    frequent = heads.where(F.col("n") > FREQUENT * pages.count()).select(place)
    often = parts.join(F.broadcast(frequent.join(best, place, "left")), place)
    seldom = parts.join(F.broadcast(frequent), place, "left_anti").join(best, place, "left")
    return often.unionByName(seldom).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
