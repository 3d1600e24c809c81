"""Column masks and row filters for a reader who belongs to some groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The group that sees everything, the start of department groups,
# the text shown for a masked value and the columns that are masked.
ADMIN_GROUP = "hospital_admin"
DEPARTMENT_GROUP = "dept_"
MASK = "***"
PERSONAL_COLUMNS = ["patient_id", "first_initial", "last_name"]


def masked(value: Column, groups: Iterable[str]) -> Column:
    """The value for an admin, the mask for anyone else (for NULL values too)."""
    return F.when(F.lit(ADMIN_GROUP in set(groups)), value).otherwise(F.lit(MASK))


def department_group(department: Column) -> Column:
    slug = F.lower(F.replace(department, F.lit(" "), F.lit("_")))
    return F.concat(F.lit(DEPARTMENT_GROUP), slug)


# Columns that a stored table is laid out by: the groups of both departments of a row.
LAYOUT = {"department_referral": "referral_group", "department": "doctor_group"}


def with_layout(df: DataFrame) -> DataFrame:
    """The table with a column per department for the group it belongs to, to partition it by."""
    return df.withColumns({
        group: department_group(F.col(column)) for column, group in LAYOUT.items() if column in df.columns
    })


def of_groups(df: DataFrame, column: str, groups: Iterable[str]) -> DataFrame:
    """Rows whose department belongs to the groups; a table laid out by it skips the other partitions."""
    stored = LAYOUT.get(column)
    group = F.col(stored) if stored in df.columns else department_group(F.col(column))
    return df.where(group.isin(sorted(groups)))


def without_layout(df: DataFrame) -> DataFrame:
    return df.drop(*LAYOUT.values())


def visible(department: Column, groups: Iterable[str]) -> Column:
    """True for rows the reader may see; rows without a department are for admins only."""
    names = set(groups)
    if ADMIN_GROUP in names:
        return F.lit(True)
    return department_group(department).isin(
        sorted(g for g in names if g.startswith(DEPARTMENT_GROUP))
    )


def secured(
    df: DataFrame,
    groups: Iterable[str],
    department: str = "department_referral",
    personal: Iterable[str] = PERSONAL_COLUMNS,
) -> DataFrame:
    """The table as the reader sees it.

    Used at read time only: gold tables are computed from whole tables, else the
    filter of whoever runs the refresh would cut the stored result.
    """
    names, hide = set(groups), set(personal)
    seen = df
    if ADMIN_GROUP not in names:
        seen = of_groups(df, department, {g for g in names if g.startswith(DEPARTMENT_GROUP)})
    shown = without_layout(seen)
    return shown.select(*[
        masked(F.col(c), names).alias(c) if c in hide else F.col(c) for c in shown.columns
    ])


def secured_for_members(
    df: DataFrame,
    members: DataFrame,
    readers: Iterable[str] | None = None,
    department: str = "department_referral",
    personal: Iterable[str] = PERSONAL_COLUMNS,
) -> DataFrame:
    """The table as each of many readers sees it, with a column ``reader``: for every reader the rows of ``secured``.

    ``members`` has ``reader`` and ``group``, once or more often each; ``readers`` picks some of them.  The groups meet the rows in a join:
    a table laid out by group reads the folders of groups that a picked reader is in, found while the job runs.  An admin is
    in every group that the table has, and sees rows without a department as well.
    """
    picked = members.select("reader", "group").where("reader IS NOT NULL AND group IS NOT NULL")
    if readers is not None:
        picked = picked.where(F.col("reader").isin(sorted(set(readers))))
    stored, hide, key = LAYOUT.get(department), set(personal), "_group"
    group = F.col(stored) if stored in df.columns else department_group(F.col(department))
    rows = df.withColumn(key, group)
    admins = picked.where(F.col("group") == ADMIN_GROUP).select("reader").distinct()
    # Folders' names alone tell the groups of a table laid out by them.
    every = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("group"), F.lit(ADMIN_GROUP).alias("of")).distinct()
    everywhere = admins.withColumn("of", F.lit(ADMIN_GROUP)).join(every, "of").select("reader", "group")
    somewhere = picked.where(F.col("group").startswith(DEPARTMENT_GROUP)).join(admins, "reader", "left_anti").distinct()
    seen = [
        rows.join(some.withColumnRenamed("group", key).withColumn("_admin", F.lit(admin)), key)
        for some, admin in ((somewhere, False), (everywhere, True))
    ]
    nowhere = rows.where(F.col(key).isNull()).withColumn(key, F.lit(ADMIN_GROUP))
    seen.append(nowhere.join(admins.select(F.lit(ADMIN_GROUP).alias(key), "reader", F.lit(True).alias("_admin")), key))
    shown = seen[0].unionByName(seen[1]).unionByName(seen[2])
    return shown.select("reader", *[
        F.when(F.col("_admin"), F.col(c)).otherwise(F.lit(MASK)).alias(c) if c in hide else F.col(c)
        for c in without_layout(df).columns
    ])


# Which groups the functions of a session were made for.
_made_for: dict[tuple[str, str], list[str]] = {}


def register_access_functions(spark: SparkSession, groups: Iterable[str], reader: str = "") -> None:
    """SQL functions ``mask_pii`` and ``department_row_filter`` for a reader in ``groups``.

    The names hold for the whole session.  Another reader gets functions of another name, with ``reader``
    and an underscore before it; the same name for other groups is an error.
    """
    names = sorted(set(groups))
    key = (spark.sparkContext.applicationId, reader)
    if _made_for.setdefault(key, names) != names:
        raise ValueError(f"the functions of reader {reader!r} are made for the groups {_made_for[key]}")
    start = f"{reader}_" if reader else ""
    admin = str(ADMIN_GROUP in names).lower()
    listed = ", ".join("'" + g.replace("'", "''") + "'" for g in names) or "NULL"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {start}mask_pii(value STRING) RETURNS STRING "
        f"RETURN CASE WHEN {admin} THEN value ELSE '{MASK}' END"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {start}department_row_filter(department STRING) RETURNS BOOLEAN "
        f"RETURN {admin} OR coalesce(concat('{DEPARTMENT_GROUP}', "
        f"lower(replace(department, ' ', '_'))) IN ({listed}), false)"
    )


def assert_no_personal_columns(df: DataFrame) -> DataFrame:
    """The same DataFrame, or an error when it carries a masked column."""
    found = sorted(set(df.columns) & set(PERSONAL_COLUMNS))
    if found:
        raise ValueError(f"personal columns in a gold table: {found}")
    return df
