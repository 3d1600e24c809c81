import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.sql.codegen.wholeStage", "false").getOrCreate()
)
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from wardlake.llm import contamination, filter_audit, language, license_scan, neighbours, secret_scan, spelling, suffix_tree_lm

texts = [f"{w} word number {i} token = \\"abc{i}def456\\" under the mit license, spelling" for i in range(12) for w in ("the", "der")]
docs = spark.createDataFrame([(i, t, t[:3]) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
assert language.with_language(docs, language.learned(docs, folds=None)).where("guess.lang = lang").count() > 20
assert secret_scan.with_secrets(docs, secret_scan.learned(docs)).where("size(spans) > 0").count() == 24
items = docs.where("doc_id = 0").select(F.col("doc_id").alias("item_id"), "text")
assert contamination.with_hits(docs, items).where("size(report.items) > 0").count() == 1
assert suffix_tree_lm.scored(docs).where("score < 0").count() == 24
vectors = spark.createDataFrame([(i, [float(i + 1), float(i * i % 7)]) for i in range(40)], "vec_id bigint, embedding array<double>")
assert neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, k=3).count() == 12
"""


def test_workers_without_a_copy_of_the_package(tmp_path):
    """Only the driver can import the package: what tasks need is sent with them."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
