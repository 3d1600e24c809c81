import __spark_entry__ as entry
import corpus_pipeline
from wardlake.llm import queries
from wardlake.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, docs, tables):
    given = table(spark, SF_DIR, "benchmark")
    given.write.mode("overwrite").parquet(f"{tables}/benchmark.parquet")
    now, ids = docs, [r["doc_id"] for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, tables)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= set(ids)
        ids = [r["doc_id"] for r in rows]
        assert all(r["guess"] == "g" and r["n_rows"] == 1 for r in rows)
        now = spark.createDataFrame(rows, docs.schema) if rows else out
    assert 0 in ids and 303 not in ids and 300 not in ids and 101 not in ids
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, tables).collect()
    assert sorted({r["doc_id"] for r in pieces if r["doc_id"] is not None}) == sorted(set(i for i in ids if i is not None))


def test_stages_on_an_empty_table(spark, no_docs, tables):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_DIR).count() == 0


def test_run_keeps_clean_documents(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    kept = {r["doc_id"] for r in pieces.collect()}
    groups = queries.op4_simhash(spark, SF_DIR).collect()
    bad = {r["doc_id"] for r in queries.op6_decontamination(spark, SF_DIR).where("contaminated").collect()}
    unknown = {r["doc_id"] for r in queries.op1_language_id(spark, SF_DIR).where("lang_pred = 'und'").collect()}
    least = {r["component_id"] for r in groups}
    assert kept == {i for i in least if i not in unknown and i not in bad}


def test_unlabelled_documents_stay(spark, tables):
    rows = [(1, "some words here", None, "s", 5), (2, "²½ ①② Ⅷ 12", None, "s", 5), (3, "日本", None, "s", 2), (4, None, "en", "s", 0), (None, "x", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    held_out = spark.createDataFrame([(i, "held out words", "en", "s", 3) for i in range(40)], docs.schema).where("crc32(cast(doc_id as string)) % 4 = 2")
    for table in (docs, docs.unionByName(held_out)):
        kept = corpus_pipeline.STAGES[0][1](spark, table, tables).collect()
        assert {r["doc_id"] for r in kept if r["text"] != "held out words"} == {1, 3, None}
        assert len(kept) == table.count() - 2


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
