from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import quality
from tests.llm.fixtures import awkward

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int, sample_key string"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    scores, model, cut = quality.classify(docs, fitted)
    held = scores.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [r["accepted"] == (r["quality"] == 1) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.93
    clean = [r["accepted"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(clean) > 0.97
    kept = quality.apply(docs, fitted)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in scores.where("kept").collect()}


def test_counts_are_those_of_all_texts(spark):
    docs = spark.createDataFrame([(i, "a b a, c!") for i in range(5)] + [(9, None)], "doc_id long, text string")
    rows = quality.with_roles(docs, quality.label_sample(spark.createDataFrame([], LABELS)))
    raw = quality.count_ngrams(rows).agg({"raw": "sum"}).first()[0]
    assert raw == 5 * (6 + 5)


def test_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], LABELS)
    scores = quality.classify(docs, none)[0].collect()
    assert sorted((r["doc_id"] or -1, r["accepted"]) for r in scores) == [(-1, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, True), (6, True), (7, True), (8, True), (9, True)]
    kept = quality.apply(docs, none)
    assert kept.columns == docs.columns and kept.count() == 8
    some = spark.createDataFrame([(1, 1, 0, None), (1, 1, 0, None), (7, 0, None, None), (None, 1, 0, None), (9, None, 0, None), (6, 1, 0, None), (5, 1, 0, None)], LABELS)
    assert quality.classify(docs, some)[0].count() == 11
    assert quality.classify(awkward(spark, empty=True), some)[0].count() == 0


def test_held_out_toxic_documents_are_rejected(spark):
    large = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    scores = quality.classify(docs, fitted)[0].cache()
    held = scores.join(labels.where("doc_id % 2 = 1").select("doc_id", "quality", F.col("toxic").alias("said")), "doc_id").collect()
    missed = [r["kept"] for r in held if r["said"] == 1 and r["quality"] == 1]
    clean = [r["toxic"] for r in held if r["said"] == 0]
    print("toxic of quality 1", len(missed), "kept", np.mean(missed), "clean", len(clean), "called toxic", np.mean(clean))
    assert len(missed) > 150 and np.mean(missed) < 0.1
    assert len(clean) > 1000 and np.mean(clean) < 0.02
    left = {r["doc_id"] for r in quality.apply(docs, fitted).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in scores.where("accepted AND NOT toxic").collect()}


def test_a_few_toxic_words_in_a_long_text(spark):
    names = "oak elm ash fir yew".split()
    plain = lambda i, n: " ".join(f"{names[(i + k) % 5]} w{(i * 31 + k * 7) % 400}" for k in range(n))
    texts = [(i, plain(i, 50) + (" vile stuff" if i % 4 == 0 else "")) for i in range(200)]
    texts += [(900, plain(3, 9000) + " vile " + plain(4, 9000)), (901, plain(5, 18000)), (902, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), None) for i in range(200)] + [(None, 1, 1, None), (902, 1, None, None)], LABELS)
    kept = {r["doc_id"]: r["toxic"] for r in quality.classify(docs, labels)[0].collect()}
    assert (kept[900], kept[901], kept[902]) == (True, False, False)
    assert all(kept[i] == (i % 4 == 0) for i in range(200))
    none = spark.createDataFrame([(i, 1, 0, None) for i in range(200)], LABELS)
    assert not quality.classify(docs, none)[0].where("toxic").count()


def test_mean_ratios_equal_a_dictionary_of_ngrams(spark):
    """Counts, log ratios and means by plain dictionaries over the words themselves."""
    import math
    import re
    from collections import Counter

    import pyarrow as pa

    texts = {i: f"good tea, plain cup {i % 7} of tea" if i % 3 else f"bad sale!! buy {i % 5} now" for i in range(60)}
    roles = {i: "target" for i in range(1, 60, 6)}
    kind = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]+")

    def grams(text):
        tokens = kind.findall(text)
        return [(t,) for t in tokens] + list(zip(tokens, tokens[1:]))

    def place(gram):
        return int(np.concatenate(quality.ngram_buckets(pa.array([" ".join(gram)]))[len(gram) * 2 - 2 :: 4])[0])

    raw, target = Counter(), Counter()
    for i, text in texts.items():
        raw.update(grams(text))
        target.update(grams(text) if i in roles else [])
    where = {g: place(g) for g in raw}
    assert len(set(where.values())) == len(where)  # no two of these share a bucket
    size = 1 << quality.BUCKET_BITS
    ratio = {g: math.log((target[g] + 1) / (target.total() + size) / ((raw[g] + 1) / (raw.total() + size))) for g in raw}
    rows = spark.createDataFrame([(i, t, roles.get(i)) for i, t in texts.items()], "doc_id long, text string, role string")
    scored = quality.mean_ratios(rows, quality.log_ratios(quality.count_ngrams(rows)), ["doc_id"]).collect()
    for r in scored:
        found = grams(texts[r["doc_id"]])
        assert r["n_ngrams"] == len(found) and abs(r["mean_ratio"] - sum(ratio[g] for g in found) / len(found)) < 1e-5
