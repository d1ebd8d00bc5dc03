"""The pipeline's stages, each against what its operator says of its input."""

from __future__ import annotations

import corpus_pipeline
from tidewater.llm import decontaminate, pii, quality, simhash
from tidewater.operators.common import materialize


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), "test")
        ids = {r["doc_id"] for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert ids == {r["doc_id"] for r in quality.judge(before).filter("kept").collect()}
        elif name == "simhash_dedup":
            assert ids == {r["component"] for r in simhash.groups(before).collect()}
        elif name == "decontamination":
            benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            leaks = {r["doc_id"] for r in decontaminate.matches(before, benchmark).collect()}
            assert ids == seen["simhash_dedup"] - leaks
        elif name == "personal_data":
            assert ids == seen["decontamination"]
            assert not pii.spans(docs).filter("size(_spans) > 0").count()
        else:
            assert ids <= seen["personal_data"] and docs.columns == [*columns, "rate", "copy"]
        seen[name] = ids
    assert seen["simhash_dedup"] < seen["quality_rules"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_takes_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "test")
    assert docs.columns[:len(odd.columns)] == odd.columns
