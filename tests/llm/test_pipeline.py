"""Registered queries of the subpackage and the pipeline on the smallest scale."""

import zlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import compare, connect
from rowecho.llm import decontam, langid, pieces, simhash
from tests.llm import cases


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_decontamination", "op9_warc"])
def test_query_equals_sql(spark, sf_dir, name):
    ok, note, _ = compare(spark, connect(sf_dir), sf_dir, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, note


def test_held_out_rows(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = contract.queries()["op1_language_id"](spark, sf_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in tested) >= 0.95 * len(tested)
    rows = contract.queries()["op2_toxicity"](spark, sf_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}


def test_stages_of_the_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_duplicates", "near_duplicates", "decontamination", "tokens"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == docs.columns and 0 < after.count() <= kept.count()
        assert after.join(kept, "doc_id", "left_anti").count() == 0
        if name == "language":
            models = langid.learn(langid.sample_texts(
                langid.learning_rows(docs), langid.SAMPLE_ROWS, langid.SAMPLE_CHARS))
            assert after.count() == langid.predict(docs, models).filter("NOT rejected").count()
        if name == "exact_duplicates":
            assert after.selectExpr("regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', ' ') t").distinct().count() == after.count()
        if name == "near_duplicates":
            assert after.count() == simhash.near_duplicates(kept).select("component_id").distinct().count()
        if name == "decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontam.contamination(after, items).filter("contaminated").count() == 0
            assert after.count() == kept.count() - decontam.contamination(kept, items).filter("contaminated").count()
        kept = after
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    want = pieces.encode(kept, pieces.default_model()).select("doc_id", "ids_sha256").collect()
    assert sorted(whole) == sorted(want)


def test_stages_take_any_table(spark, sf_dir):
    for docs in (cases.docs(spark), cases.no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            assert stage(spark, docs, sf_dir).count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
