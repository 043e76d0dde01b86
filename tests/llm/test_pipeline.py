from __future__ import annotations

import hashlib

import corpus_pipeline
from attesta.llm import neardup, pii, quality
from tests.llm.fixtures import awkward
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "personal_data", "target_mixture", "tokens"]
    inputs, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        inputs = stage(spark, inputs, SF).cache()
        frames.append({r["doc_id"]: r for r in inputs.collect()})
        if stage is not corpus_pipeline.tokens:
            assert inputs.columns == docs.columns
    accepted, single, clean, mixed, done = frames
    scores = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))[0]
    assert set(accepted) == {r["doc_id"] for r in scores.where("accepted AND NOT toxic").collect()}
    assert set(single) == {k for k, (_, _, kept) in brute({k: r["text"] for k, r in accepted.items()}).items() if kept}
    assert set(clean) == set(single) and not any(pii.base_spans(r["text"]) for r in clean.values())
    assert set(mixed) <= set(clean) and set(done) == set(mixed)
    assert all(r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in done.values())
    again = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == sorted((r["doc_id"], r["ids_sha256"]) for r in inputs.collect())


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (False, True):
        docs = awkward(spark, empty)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == awkward(spark).columns
        assert (corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == 0) == empty
    assert neardup.PERCENT == 75
