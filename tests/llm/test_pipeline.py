"""The stages of the pipeline, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data, tmp_path):
    from rulewright.llm import quality, secrets

    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.cache()
        if name != "packing":
            assert docs.columns == first.columns
    want = {r.doc_id for r in quality.judge(first).where("kept").collect()}
    assert {r.doc_id for r in kept["quality"].collect()} == want
    by_text = {}
    for r in kept["quality"].collect():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == set(by_text.values())
    near = {r.doc_id for r in kept["near_dedup"].collect()}
    assert near <= set(by_text.values()) and len(near) >= 0.8 * len(by_text)
    assert {r.doc_id for r in kept["secrets"].collect()} == near
    assert secrets.scan(kept["secrets"]).where("spans != ''").count() == 0
    assert {r.doc_id for r in kept["packing"].select("doc_id").distinct().collect()} == near
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark, data):
    assert pipeline.run(spark, data).count() > 0
