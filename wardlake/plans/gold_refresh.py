"""Gold kept by changes: visits and doctors that changed, and nothing else, go through the join and the roll-ups.

The gold table lies in folders by the groups of both departments.  A refresh reads and rewrites
the folders that changed rows are in or move to; the five roll-ups are kept as sums, from which the rows that went are
taken away and to which those that came are added.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wardlake.operators import rollups
from wardlake.operators.access import LAYOUT, assert_no_personal_columns, with_layout, without_layout
from wardlake.operators.enrich import changed_doctors, enrich_visits, visits_to_join_again
from wardlake.schemas import GOLD_VISITS

PLACE = list(LAYOUT.values())
LAID_OUT = f"{GOLD_VISITS}, " + ", ".join(f"{c} STRING" for c in PLACE)
# Folders that are named in a filter of the scan; a refresh that touches more reads all of gold.
MOST_NAMED = 10_000


def in_places(places: list[Row]) -> Column:
    """Rows of these folders; each column's values alone, as Spark prunes folders by, then both together."""
    by_column = [F.lit(False), F.lit(False)]
    for at, column in enumerate(PLACE):
        known = sorted({p[column] for p in places} - {None})
        by_column[at] = F.col(column).isin(known) if known else F.lit(False)
        if any(p[column] is None for p in places):
            by_column[at] = by_column[at] | F.col(column).isNull()
    exact = F.lit(False)
    for place in places:
        here = [F.col(c).isNull() if place[c] is None else F.col(c) == place[c] for c in PLACE]
        exact = exact | (here[0] & here[1])
    return by_column[0] & by_column[1] & exact


class GoldTables:
    """Gold visits, the doctors they were joined to, and the sums of the five roll-ups, below ``root``.

    ``start`` makes them from whole tables as version 0; ``apply`` takes them from one version to the next by a feed of changed
    visits (``change`` and the columns of a visit) and the doctors as they are now.  A refresh is staged whole, noted, then
    published; a run that died in between is published by the next call.  A version that is there already is not applied again.
    Superseded versions of doctors and sums, and what was staged, are deleted at the end.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _read(self, *parts: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(self.path(*parts))

    def _write(self, df: DataFrame, *parts: str, by_place: bool = False) -> None:
        df.write.mode("overwrite").partitionBy(*(PLACE if by_place else [])).parquet(self.path(*parts))

    def _delete(self, *parts: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(*parts))
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _note(self, name: str, version: int) -> None:
        self._write(self.spark.range(1, numPartitions=1).select(F.lit(version).alias("version")), name)

    def _noted(self, name: str) -> int:
        try:
            return self._read(name, schema="version INT").first()["version"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1

    def version(self) -> int:
        """The version the tables are at, -1 before the start."""
        return self._noted("current")

    def gold(self) -> DataFrame:
        return without_layout(self._gold())

    def _gold(self) -> DataFrame:
        return self._read("gold", schema=LAID_OUT)

    def doctors(self) -> DataFrame:
        return self._read(f"doctors-{self.version()}")

    def rollup(self, name: str) -> DataFrame:
        """One of the five roll-ups, from its sums."""
        return rollups.finished(self._read(f"sums-{self.version()}", name), name)

    def start(self, visits: DataFrame, doctors: DataFrame) -> None:
        self._write(doctors, "doctors-0")
        gold = assert_no_personal_columns(enrich_visits(visits, self._read("doctors-0")))
        self._write(with_layout(gold), "gold", by_place=True)
        for name in rollups.ROLLUPS:
            self._write(rollups.partials(self.gold(), name), "sums-0", name)
        self._note("current", 0)

    def apply(self, feed: DataFrame, doctors: DataFrame, version: int) -> None:
        """Take the tables to ``version``, the next one.  ``feed`` holds all visits that changed since the one before."""
        self._publish()
        if version <= self.version():
            return
        if version != self.version() + 1:
            raise ValueError(f"version {version} does not follow {self.version()}")
        self._stage(feed, doctors)
        self._note("staged", version)
        self._publish()

    def _named(self, places: DataFrame) -> Column:
        """A filter for these folders."""
        named = places.select(*PLACE).distinct().take(MOST_NAMED + 1)
        return in_places(named) if len(named) <= MOST_NAMED else F.lit(True)

    def _stage(self, feed: DataFrame, doctors: DataFrame) -> None:
        before = self.doctors()
        self._write(feed, "stage", "feed")
        self._write(doctors, "stage", "doctors")
        feed, after = self._read("stage", "feed"), self._read("stage", "doctors")
        # Where the rows of changed visits are now, and those of changed doctors: with their old departments, or without one.
        then = feed.where("change = 'update_preimage'")
        old_rows = with_layout(enrich_visits(then, before))
        changed = changed_doctors(before, after)
        doctor_group = with_layout(changed.join(before.select("doctor_id", "department"), "doctor_id", "left")).select(PLACE[1])
        groups = [r[0] for r in doctor_group.distinct().take(MOST_NAMED + 1)]
        of_doctors = F.col(PLACE[1]).isin([g for g in groups if g is not None])
        if None in groups:
            of_doctors = of_doctors | F.col(PLACE[1]).isNull()
        if len(groups) > MOST_NAMED:
            of_doctors = F.lit(True)
        again = visits_to_join_again(self._gold().where(of_doctors), feed, before, after)
        self._write(with_layout(enrich_visits(again, after)), "stage", "plus", by_place=True)
        plus = self._read("stage", "plus", schema=LAID_OUT)
        # As many as changed: sorted on both sides, as a broadcast of them would pass through the driver.
        touched = plus.select("visit_id").unionByName(feed.select("visit_id")).distinct().hint("merge")
        old_gold = self._gold().where(of_doctors | self._named(old_rows))
        self._write(old_gold.join(touched, "visit_id", "left_semi"), "stage", "minus", by_place=True)
        minus = self._read("stage", "minus", schema=LAID_OUT)
        here = self._gold().where(self._named(plus.select(*PLACE).unionByName(minus.select(*PLACE))))
        kept = here.join(touched, "visit_id", "left_anti")
        self._write(kept.select(plus.columns).unionByName(plus), "stage", "content", by_place=True)

    def _publish(self) -> None:
        version = self._noted("staged")
        last = self.version()
        if version <= last:
            return
        plus, minus = (self._read("stage", part, schema=LAID_OUT) for part in ("plus", "minus"))
        content = self._read("stage", "content", schema=LAID_OUT)
        content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(self.path("gold"))
        # Folders that rows left and none came to are not overwritten.
        left = minus.select(*PLACE).distinct().join(content.select(*PLACE).distinct(), [
            minus[c].eqNullSafe(content[c]) for c in PLACE
        ], "left_anti")
        for place in left.collect():
            self._delete("gold", *[f"{c}={'__HIVE_DEFAULT_PARTITION__' if place[c] is None else _escaped(place[c])}" for c in PLACE])
        for name in rollups.ROLLUPS:
            # Both at once: a group with as many rows as before may still have other sums.
            change = rollups.partials(plus, name).unionByName(rollups.partials(minus, name, -1))
            self._write(rollups.added(self._read(f"sums-{last}", name), change, name), f"sums-{version}", name)
        self._write(self._read("stage", "doctors"), f"doctors-{version}")
        self._note("current", version)
        for folder in (f"sums-{last}", f"doctors-{last}", "stage"):
            self._delete(folder)


def _escaped(value: str) -> str:
    """A folder name as Spark writes it for a value."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in '"#%\'*/:=?\\\x7f{[]^' else c for c in value)
