"""Keyed merge that touches only rows whose content changed, and its change feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC_KEY = "doc_id"
# The columns whose change makes a document an updated one.
DOC_CONTENT = ["text", "department", "period", "doc_type"]


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """The same rows; the job fails where a key occurs twice.

    A merge has no right answer then.  The group-by places the rows by key, as the
    merge join needs them, so the check costs no shuffle of its own.
    """
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count("*").alias("_copies"), F.first(F.struct(*others)).alias("_row")
    )
    message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
    row = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(
        F.raise_error(message).cast(grouped.schema["_row"].dataType)
    )
    return grouped.select(key, row.alias("_row")).select(key, "_row.*").select(*df.columns)


def classify(
    current: DataFrame, incoming: DataFrame, key: str = DOC_KEY, content: list[str] = DOC_CONTENT
) -> DataFrame:
    """Both tables side by side with ``op``: insert, update, delete or unchanged.

    Content compares NULL-safe.  Columns: key, ``op``, structs ``old`` and ``new``.
    """
    old = one_row_per_key(current.select(key, *content), key).select(
        F.col(key).alias("_old_key"), F.struct(key, *content).alias("old")
    )
    new = one_row_per_key(incoming.select(key, *content), key).select(
        F.col(key).alias("_new_key"), F.struct(key, *content).alias("new")
    )
    same = reduce(
        lambda a, b: a & b, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in content]
    )
    op = (
        F.when(F.col("_old_key").isNull(), "insert")
        .when(F.col("_new_key").isNull(), "delete")
        .when(same, "unchanged")
        .otherwise("update")
    )
    return old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer").select(
        F.coalesce("_old_key", "_new_key").alias(key), op.alias("op"), "old", "new"
    )


def change_feed(classified: DataFrame, key: str = DOC_KEY, content: list[str] = DOC_CONTENT) -> DataFrame:
    """``op`` and the content of each changed row: the new content, for deletes the old."""
    row = F.when(F.col("op") == "delete", F.col("old")).otherwise(F.col("new"))
    return classified.where("op <> 'unchanged'").select(
        key, "op", *[row[c].alias(c) for c in content]
    )


def merged(classified: DataFrame, key: str = DOC_KEY, content: list[str] = DOC_CONTENT) -> DataFrame:
    """The table after the merge."""
    return classified.where("op <> 'delete'").select(
        key, *[F.col(f"new.{c}").alias(c) for c in content]
    )


def changes(
    current: DataFrame, incoming: DataFrame, key: str = DOC_KEY, content: list[str] = DOC_CONTENT
) -> DataFrame:
    return change_feed(classify(current, incoming, key, content), key, content)


def apply_changes(
    current: DataFrame, feed: DataFrame, key: str = DOC_KEY, content: list[str] = DOC_CONTENT
) -> DataFrame:
    """``current`` with a change feed played onto it."""
    kept = current.join(feed.select(key), key, "left_anti").select(key, *content)
    return kept.unionByName(feed.where("op <> 'delete'").select(key, *content))
