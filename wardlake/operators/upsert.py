"""Current state by key (SCD type 1), in batch form, and the feed of its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISIT_KEY = ["visit_id"]
VISIT_SEQUENCE = "bronze_timestamp"
# Same sequence, same key: the later source row wins.
VISIT_TIES = ["source_file", "source_row"]


def sequenced(df: DataFrame, sequence: str = VISIT_SEQUENCE) -> DataFrame:
    """Rows that can take part in an upsert."""
    return df.where(F.col(sequence).isNotNull())


def unsequenced(df: DataFrame, sequence: str = VISIT_SEQUENCE) -> DataFrame:
    """Rows without a sequence value, for quarantine: nothing says which state they hold."""
    return df.where(F.col(sequence).isNull())


def latest_by_key(
    df: DataFrame,
    keys: list[str] = VISIT_KEY,
    sequence: str = VISIT_SEQUENCE,
    ties: list[str] = VISIT_TIES,
    within: list[str] | None = None,
) -> DataFrame:
    """The row with the greatest sequence of every key.

    ``row_number() = 1`` becomes a group limit ahead of the shuffle, so each task
    sends on at most one row per key however often a key occurs.  What is left of
    a tie after ``ties`` is decided by the row's content, never by arrival.

    ``within`` names columns that are a function of the key; the rows may already
    be placed by them, and then this adds no shuffle.
    """
    decided = {*keys, *(within or []), sequence, *ties, "silver_timestamp"}
    rest = [c for c in df.columns if c not in decided]
    order = [F.desc(c) for c in [sequence, *ties]] + [F.desc(F.xxhash64(*rest)) if rest else F.lit(0)]
    newest = Window.partitionBy(*(within or []), *keys).orderBy(*order)
    return (
        sequenced(df, sequence)
        .withColumn("_newest", F.row_number().over(newest))
        .where("_newest = 1")
        .drop("_newest")
    )


# What a row of a change feed is: the row before an update, the row after it, or a new row.
INSERT, BEFORE, AFTER = "insert", "update_preimage", "update_postimage"
# Columns whose change alone makes no changed row: when a row was processed.
UNWATCHED = ["silver_timestamp"]


def upserted(
    df: DataFrame,
    keys: list[str] = VISIT_KEY,
    sequence: str = VISIT_SEQUENCE,
    ties: list[str] = VISIT_TIES,
    within: list[str] | None = None,
) -> DataFrame:
    """The newest row of every key, what happened to it (``_change``) and the row before an update (``_before``).

    ``df`` holds at most one current and one new row per key, told apart by a boolean ``_new``.  ``_change`` is ``insert``,
    ``update`` or null.  A new row that is older than the current one, or equal to it in all but the time it was processed, changes nothing.
    Both rows of a key meet once, in the window that the upsert needs anyway.
    """
    columns = [c for c in df.columns if c not in {"_new", *(within or [])}]
    decided = {*keys, sequence, *ties, *UNWATCHED}
    rest = [c for c in columns if c not in decided]
    order = [F.desc(c) for c in [sequence, *ties]] + [F.desc(F.xxhash64(*rest)) if rest else F.lit(0), F.asc("_new")]
    newest = Window.partitionBy(*(within or []), *keys).orderBy(*order)
    ranked = df.withColumns({
        "_newest": F.row_number().over(newest), "_before": F.lead(F.struct(*columns)).over(newest),
    }).where("_newest = 1")
    same = F.lit(True)
    for c in columns:
        if c not in UNWATCHED:
            same = same & F.col(c).eqNullSafe(F.col("_before")[c])
    change = F.when(F.col("_new") & F.col("_before").isNull(), "insert").when(F.col("_new") & ~same, "update")
    return ranked.withColumn("_change", change).withColumn(
        "_before", F.when(F.col("_change") == "update", F.col("_before"))
    ).drop("_newest", "_new")


def change_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The feed of ``upserted`` rows: ``change`` and the columns, two rows for an update, one for an insert."""

    def row(kind: str, prefix: str = "") -> Column:
        return F.struct(F.lit(kind).alias("change"), *[F.col(f"{prefix}{c}").alias(c) for c in columns])

    both = F.when(F.col("_change") == "insert", F.array(row(INSERT))).otherwise(F.array(row(BEFORE, "_before."), row(AFTER)))
    return rows.where("_change IS NOT NULL").select(F.inline(both))


def changes_by(current: DataFrame, batch: DataFrame, keys: list[str] = VISIT_KEY, sequence: str = VISIT_SEQUENCE) -> DataFrame:
    """The feed that a batch of rows brings to a current state."""
    new = latest_by_key(batch, keys, sequence).withColumn("_new", F.lit(True))
    old = current.select(*[c for c in new.columns if c != "_new"]).withColumn("_new", F.lit(False))
    columns = [c for c in new.columns if c != "_new"]
    return change_rows(upserted(old.unionByName(new), keys, sequence), columns)


def feed_applied(current: DataFrame, feed: DataFrame, keys: list[str] = VISIT_KEY) -> DataFrame:
    """The state after a feed: rows of other keys as they were, and the rows after each change."""
    kept = current.join(feed.select(*keys), keys, "left_anti").select(current.columns)
    return kept.unionByName(feed.where(F.col("change") != BEFORE).select(current.columns))
