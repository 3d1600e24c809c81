"""The tables of the platform and the order they are made in.

``Lake`` keeps them below one folder.  Each table is written once and read by all
that follow from it: five roll-ups share one scan-friendly gold table instead of
cleaning and joining the visits five times.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardlake.operators import corpus, merge, rollups
from wardlake.operators.access import LAYOUT, assert_no_personal_columns, with_layout, without_layout
from wardlake.operators.doctors import clean_doctors
from wardlake.operators.enrich import enrich_visits
from wardlake.operators.patients import clean_visits
from wardlake.operators.quality import DOCTOR_RULES, VISIT_RULES, expect
from wardlake.operators.retrieval import Embedder, embed_changes, refresh_vectors
from wardlake.operators.upsert import latest_by_key, unsequenced
from wardlake.schemas import (
    DEPARTMENT_MONTH,
    DOCTORS,
    GOLD_VISITS,
    INSIGHT_DOCS,
    SILVER_VISITS,
    enforce_schema,
)

# Declared schemas; the other tables take the schema of their query.
DECLARED = {
    "doctors": DOCTORS,
    "visits_enriched": GOLD_VISITS,
    "department_monthly_stats": DEPARTMENT_MONTH,
}
# Tables stored in folders by department group, so that a reader's filter skips the others.
BY_GROUP = {"visits_enriched"}
# Folders by version have the schema of their first name.
DECLARED_VERSIONS = {"corpus": INSIGHT_DOCS}


def declared(name: str, df: DataFrame) -> DataFrame:
    """The columns, order and types declared for a table, if any; a null where none may be stops the write."""
    ddl = DECLARED.get(name) or DECLARED_VERSIONS.get(name.split("/")[0])
    if not ddl:
        return df
    kinds = StructType.fromDDL(ddl)
    more = [f for f in df.schema.fields if f.name not in kinds.names] if name == "doctors" else []
    df = df.to(StructType([f if f.nullable else StructField(f.name, f.dataType) for f in kinds.fields] + more))
    return df.withColumns({
        f.name: F.coalesce(f.name, F.raise_error(F.lit(f"{name}: {f.name} is null")).cast(f.dataType))
        for f in kinds.fields if not f.nullable
    })


def current_visits(bronze: DataFrame, observation=None) -> DataFrame:
    """Bronze to current clean visits, in one batch; see ``split_visits`` for what is left out."""
    return split_visits(bronze, observation)[0]


def split_visits(bronze: DataFrame, observation=None) -> tuple[DataFrame, DataFrame]:
    """Current clean visits, and the rows for quarantine: those without a sequence value."""
    visits = expect(enforce_schema(clean_visits(bronze), SILVER_VISITS), VISIT_RULES, observation)
    return latest_by_key(visits), unsequenced(visits)


def silver_doctors(raw: DataFrame, observation=None) -> DataFrame:
    """The declared columns first, then any others the doctors come with."""
    clean = expect(clean_doctors(raw), DOCTOR_RULES, observation)
    declared = StructType.fromDDL(DOCTORS)
    more = [f for f in clean.schema.fields if f.name.lower() not in {n.lower() for n in declared.names}]
    return clean.to(StructType([*declared.fields, *more]))


class Lake:
    """Tables as parquet folders below ``root``.

    A table is written to a new folder, then a row is added that names it; readers take the last one named.
    So a reader never sees half a table, and a refresh that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _named(self, name: str) -> str:
        names = self.spark.read.schema("at BIGINT, folder STRING").parquet(f"{self.path(name)}/names")
        return names.agg(F.max_by("folder", "at")).first()[0]

    def read(self, name: str, laid_out: bool = False) -> DataFrame:
        """The table as it was last written; ``laid_out`` leaves the partition columns in."""
        df = self.spark.read.parquet(f"{self.path(name)}/{self._named(name)}")
        return df if laid_out else without_layout(df)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table by a query result."""
        df = declared(name, df)
        if name in BY_GROUP:
            df = with_layout(df)
        folder = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy(*[c for c in LAYOUT.values() if c in df.columns]).parquet(f"{self.path(name)}/{folder}")
        named = self.spark.range(1, numPartitions=1).select(
            F.lit(time.time_ns()).alias("at"), F.lit(folder).alias("folder")
        )
        named.write.mode("append").parquet(f"{self.path(name)}/names")
        return self.read(name)

    def refresh_visits(self, bronze: DataFrame) -> DataFrame:
        """Current visits from all of bronze; rows without a sequence value go to ``visits_quarantine``."""
        current, unsequenced_rows = split_visits(bronze)
        self.write("visits_quarantine", unsequenced_rows)
        return self.write("visits", current)

    def refresh_gold(
        self, visits: DataFrame, raw_doctors: DataFrame, unique_doctors: bool = False
    ) -> None:
        """The doctors and all gold tables, from the current visits and the doctors as they come.

        Always over whole tables: row filters are for readers of the result.  With
        ``unique_doctors`` a doctor given twice stops the job; else its visits double.
        """
        doctors = silver_doctors(raw_doctors)
        if unique_doctors:
            doctors = merge.one_row_per_key(doctors, "doctor_id")
        doctors = self.write("doctors", doctors)
        gold = assert_no_personal_columns(enrich_visits(visits, doctors))
        gold = self.write("visits_enriched", gold)
        for name in rollups.ROLLUPS:
            self.write(name, rollups.rollup(gold, name))

    def refresh_corpus(self, version: int, embedder: Embedder | None = None) -> DataFrame:
        """Merge the gold sentences into the corpus as ``version``; returns the change feed.

        Versions only grow.  Each writes folders of its own and reads the one before,
        so running a version again replaces what it wrote and nothing else.
        """
        docs = corpus.insight_docs(
            self.read("department_monthly_stats"), self.read("doctor_performance")
        )
        before = self.corpus(version - 1)
        classified = merge.classify(before, docs)
        self.write(f"corpus_changes/version={version}", merge.change_feed(classified))
        self.write(f"corpus/version={version}", merge.merged(classified))
        feed = self.read(f"corpus_changes/version={version}")
        if embedder is not None:
            # Written first: each text is embedded once, and the join knows the size.
            embedded = self.write(
                f"corpus_vector_changes/version={version}", embed_changes(feed, embedder)
            )
            vectors = refresh_vectors(self.vectors(version - 1), embedded)
            self.write(f"corpus_vectors/version={version}", vectors)
        return feed

    def _version(self, name: str, version: int, schema: str) -> DataFrame:
        if version < 1:
            return self.spark.createDataFrame([], schema)
        return self.read(f"{name}/version={version}")

    def corpus(self, version: int) -> DataFrame:
        return self._version("corpus", version, INSIGHT_DOCS)

    def vectors(self, version: int) -> DataFrame:
        return self._version("corpus_vectors", version, "doc_id STRING, vector ARRAY<FLOAT>")
