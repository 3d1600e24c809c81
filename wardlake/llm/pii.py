"""Personal data: fixed patterns, and identifiers found through the words around those.

The fixed patterns' matches are seeds.  The words to their left and right are lexical patterns; a graph joins
patterns with all that stands where they point.  Patterns are scored by what they catch, instances by the patterns
that catch them, in turns; what good patterns catch and no fixed pattern matches is found data.
Everything is built-in functions of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import stored

# The kinds in the order in which they are listed.  Each pattern gives the matches of its plain form in time that
# grows with the text: a match begins where a run begins or the last match ended, and no run is given back.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Longer and shorter runs of digits match nothing, as they would be dropped whole.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
MARKS = {"email": "@", "phone": "+"}
# A word that may be an identifier: it holds a digit or an at sign.
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT_CHARS = 200
BLOCK = 256

ROUNDS = 3
LEAST_SUPPORT = 3  # different instances that a pattern must catch
LEAST_CONFIDENCE = 0.5  # share of a pattern's occurrences that are instances
LEAST_SCORE = 0.8  # of a new instance: one less the chance that all its patterns err


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _steps(n: Column) -> Column:
    """0 .. n - 1; empty for zero."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def with_matches(df: DataFrame, text: str, pattern: str, into: str, tried: Column) -> DataFrame:
    """``df`` with an array ``into`` of all matches: start, stop, value, and the words left and right.

    What stands between the matches is split off; lengths are summed up in blocks, so that
    a text of very many matches is no square of work.
    """
    gaps, values, lengths, blocks, starts = (f"_{into}_{x}" for x in ("gaps", "values", "lengths", "blocks", "starts"))
    none = F.expr("cast(array() as array<string>)")
    whole = F.col(text)
    df = df.withColumn(values, F.when(tried, F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(values) > 0, F.split(whole, pattern, -1)).otherwise(none))
    n = F.size(values)
    df = df.withColumn(lengths, F.transform(_steps(n), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(values, i))))
    df = df.withColumn(blocks, F.transform(_steps(F.ceil(n / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, BLOCK))))
    df = df.withColumn(starts, F.transform(_steps(F.size(blocks)), lambda b: _sum(F.slice(blocks, F.lit(1), b))))

    def match(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        gap, value = F.get(gaps, i), F.get(values, i)
        start = F.get(starts, block) + _sum(F.slice(lengths, block * BLOCK + 1, i % BLOCK)) + F.length(gap)
        return F.struct(
            start.cast("bigint").alias("start"),
            (start + F.length(value)).cast("bigint").alias("stop"),
            value.alias("value"),
            F.lower(F.regexp_extract(F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS), r"(\S+)\s*\z", 1)).alias("left"),
            F.lower(F.regexp_extract(F.substring(F.get(gaps, i + 1), 1, CONTEXT_CHARS), r"\A\s*(\S+)", 1)).alias("right"),
        )

    return df.withColumn(into, F.transform(_steps(n), match)).drop(gaps, values, lengths, blocks, starts)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits divides by ten."""
    n = F.length(digits)

    def part(i: Column) -> Column:  # i counts from the right, from zero
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return _sum(F.transform(_steps(n), part)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return passes_luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _tried(kind: str, text: Column) -> Column:
    if kind in MARKS:
        return text.contains(MARKS[kind])
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")


def with_base_spans(df: DataFrame, text: str, into: str = "base") -> DataFrame:
    """``df`` with an array ``into`` of the fixed patterns' spans, by kind as listed, then start."""
    for kind in KINDS:
        df = with_matches(df, text, PATTERNS[kind], f"_{kind}", _tried(kind, F.col(text)))

    def named(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda m: _holds(kind, m["value"]))
        return F.transform(good, lambda m: m.withField("kind", F.lit(kind)))

    return df.withColumn(into, F.concat(*[named(kind) for kind in KINDS])).drop(*[f"_{kind}" for kind in KINDS])


def _edges(found: DataFrame, *names: str) -> DataFrame:
    """One row per instance and pattern (a side and a word there) with how often they meet."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"m.{side}").alias("word")) for side in ("left", "right")])
    return (
        found.select(*names, F.col("m.value").alias("value"), F.explode(sides).alias("s"))
        .select(*names, "value", "s.side", "s.word").where("word != ''")
        .groupBy(*names, "value", "side", "word").agg(F.count("*").alias("n"))
    )


def induced(spans: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """New instances ``value, kind`` and the patterns ``kind, side, word, confidence`` that catch them.

    ``spans`` has arrays ``base`` and ``candidates``; ``words`` counts every ``word`` as ``total``.  In each round a pattern's confidence
    is the share of its word's occurrences at which it points to an instance, each counted by its score.  Instances found in one round
    induce patterns of their own in the next.
    """
    seeds = _edges(spans.select(F.explode("base").alias("m")).select(F.col("m.kind").alias("kind"), "m"), "kind")
    seeds = stored(seeds, "pii-seeds")
    every = stored(_edges(spans.select(F.explode("candidates").alias("m"))), "pii-edges")
    # A word can become a pattern, in any round, only if enough stands where it points, were all of that instances.
    most = (
        seeds.select("side", "word", "n").union(every.select("side", "word", "n"))
        .groupBy("side", "word").agg(F.count("*").alias("support"), F.sum("n").alias("hits")).where(F.col("support") >= LEAST_SUPPORT)
    )
    # The join stays above the counting; a semi join would be moved below and deal out every word of every text.
    totals = stored(
        most.join(words, "word", "left").select("side", "word", "hits", F.coalesce("total", F.lit(0)).alias("total"))
        .where(F.col("hits") >= LEAST_CONFIDENCE * F.col("total")).drop("hits"),
        "pii-words",
    )
    open_edges = stored(every.join(totals.select("side", "word"), ["side", "word"], "left_semi"), "pii-candidates")
    edges = seeds.select("kind", "value", "side", "word", "n", F.lit(1.0).alias("score"))
    patterns = found = None
    for _ in range(rounds):
        caught = edges.groupBy("kind", "side", "word").agg(
            F.count_distinct("value").alias("support"), F.sum(F.col("n") * F.col("score")).alias("hits")
        ).where(F.col("support") >= LEAST_SUPPORT)
        patterns = (
            caught.join(totals, ["side", "word"])
            .withColumn("confidence", F.least(F.lit(0.99), F.col("hits") / F.greatest("hits", "total")))
            .where(F.col("confidence") >= LEAST_CONFIDENCE)
            .select("kind", "side", "word", "confidence")
        )
        patterns = stored(patterns, "pii-patterns")
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        found = open_edges.join(patterns, ["side", "word"]).groupBy("value", "kind").agg((1 - doubt).alias("score"))
        found = stored(found.where(F.col("score") >= LEAST_SCORE), "pii-found")
        grown = open_edges.join(found, "value").select("kind", "value", "side", "word", "n", "score")
        edges = seeds.select("kind", "value", "side", "word", "n", F.lit(1.0).alias("score")).union(grown)
    return found, patterns


def found_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` spans and ``added`` spans, arrays of kind, start and stop.

    Starts and stops count code points, the stop excluded.  A null text counts as empty and has no spans.
    Rows may repeat; other columns are not read; an empty table gives no rows.  An added span
    touches no base span; its kind is that of the seeds whose patterns caught it, with ``like_`` before it.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = with_base_spans(whole, "text")
    read = with_matches(read, "text", IDENTIFIER, "candidates", F.col("text").rlike("[0-9@]"))
    spans = stored(read.drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    words = (
        whole.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    )
    found, patterns = induced(spans, words, rounds)
    m = F.col("m")
    here = spans.select("row", "base", F.explode("candidates").alias("m"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), m[side].alias("word")) for side in ("left", "right")])
    caught = (
        here.select("row", "base", "m", m["value"].alias("value"), F.explode(sides).alias("s"))
        .select("*", "s.side", "s.word").drop("s")
        .join(patterns.select("kind", "side", "word"), ["side", "word"])
        .join(found.select("value", "kind", "score"), ["value", "kind"])
        .where(~F.exists("base", lambda b: (b["start"] < F.col("m")["stop"]) & (b["stop"] > F.col("m")["start"])))
        # Two kinds may claim a span: the better score has it, then the earlier kind.
        .groupBy("row", m["start"].alias("start"), m["stop"].alias("stop"))
        .agg(F.max_by("kind", F.struct("score", -F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))).alias("kind"))
    )
    added = caught.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", F.concat(F.lit("like_"), "kind").alias("kind")))).alias("added")
    )
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop")))
    more = F.transform("added", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop")))
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,stop:bigint>>)")
    return spans.join(added, "row", "left").select("doc_id", slim.alias("base"), F.coalesce(more, empty).alias("added"))
