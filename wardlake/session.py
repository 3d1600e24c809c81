"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators count on.  Dates are hashed into keys as text, so the
# zone has to be the same for every run.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
    # HotSpot never compiles a method above 8000 bytes of bytecode.  A wide cleaning
    # projection fused into one larger method runs interpreted, at half the speed.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Below this file size the doctors go to every executor and the visits stay in
    # place; above it both sides are sorted by key and hot keys are split.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # Of a key given twice in a JSON text the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows of long texts go to Python as lists of words: keep a batch small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(
    app_name: str = "wardlake",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above.

    On a cluster leave ``shuffle_partitions`` high (about input bytes / 128 MB):
    adaptive execution merges the ones that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CORE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_core_conf(spark: SparkSession) -> SparkSession:
    """Put the settings above on a session that someone else made."""
    for key, value in CORE_CONF.items():
        spark.conf.set(key, value)
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # Executors of ``local-cluster`` are processes of their own and count as a cluster.
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="wardlake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, below the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
