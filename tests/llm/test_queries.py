"""Every query of the subpackage runs; those with SQL equal DuckDB; the pipeline keeps its promises."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import partition_join, toxicity
from kbspark.llm.queries import ORACLES, QUERIES
from tests.compare import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    ok, note = compare(spark, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, note


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    toxic = {r.doc_id for r in QUERIES["op8_toxicity_lexicon"](spark, SF_DIR).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, SF_DIR), "test-stage")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert docs.count() == rows - len(toxic) and not ids & toxic
        if name == "ngram_jaccard_join":
            found = partition_join.jaccard_components(before).collect()
            assert ids == {r.doc_id for r in found if r.doc_id == r.component_id} and docs.count() == len(ids)
        assert docs.columns[:5] == columns
    assert docs.where("not round_trip").count() == 0 and toxicity.THRESHOLD == 0.7


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeats, rows without ids, and columns called like helpers."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = " ".join(f"word{i} of" for i in range(40))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " more", None, "a", None), (None, base, None, None, None),
            (None, "lost and found", "en", "b", 2), (None, None, "en", "b", 2), (4, None, "en", "b", 0), (5, "", "en", None, 0),
            (6, " \t\n", "en", "a", 3), (7, " ".join(f"long{i}" for i in range(60_000)), "en", "b", 9), (8, "one", "en", "c", 3),
            (9, "one", "en", "c", 3), (10, "two\u2581 words", "en", "c", 3)]
    extra = ("score", "__score", "linked", "__linked", "turn", "__turn", "__id", "__at", "__takes", "plan_doc_id", "takes", "at", "size", "key")
    docs = spark.createDataFrame(rows, schema)
    for name in extra:
        docs = docs.withColumn(name, F.lit(name))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), "odd-stage")
        assert docs.columns[:len(before.columns)] == before.columns and stage(spark, before.limit(0), str(tmp_path)).count() == 0
        out[name] = docs.collect()
        assert all(r[c] == c for r in out[name] for c in extra)
    assert len(out["toxicity"]) == len(rows)
    assert sorted(r.doc_id for r in out["ngram_jaccard_join"] if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 10]
    assert sum(r.doc_id is None for r in out["ngram_jaccard_join"]) == 3
    assert all(r.text and r.text.strip() for r in out["mixing"]) and all(r.round_trip for r in out["sentencepiece"])
    assert {(r.doc_id, r.text) for r in out["mixing"]} <= {(r[0], r[1]) for r in rows}
    assert all(sum((r.doc_id, r.text, r.source) == (i, t, s) for r in out["mixing"]) <= 2 for i, t, _, s, _ in rows)
