from __future__ import annotations

import hashlib

import numpy as np
import pytest

from attesta.llm import fingerprints as fp
from tests.llm.fixtures import awkward, documents


def shingles(text):
    return {text[i : i + fp.WIDTH] for i in range(max(1, len(text) - fp.WIDTH + 1))} if text else set()


def test_each_row_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    out = {r["doc_id"]: r for r in fp.compare_with_next(docs).collect()}
    assert len(out) == len(rows)
    errors = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        row = out[doc]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["fingerprint"] == fp.to_text(fp.sketch(text)) and row["edited_fingerprint"] == fp.to_text(fp.sketch(changed))
        a, b = shingles(text), shingles(changed)
        errors.append(abs(row["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)))
    assert np.mean(errors) < 0.06


def test_short_texts_are_compared_exactly_and_merge_is_the_union():
    a, b = "the quick brown fox", "the quick brown dog"
    x, y = shingles(a), shingles(b)
    assert fp.likeness(fp.sketch(a), fp.sketch(b)) == pytest.approx(len(x & y) / len(x | y))
    assert fp.containment(fp.sketch("quick brown"), fp.sketch(a)) == 1.0
    assert fp.likeness(fp.sketch(""), fp.sketch("")) == 1.0 and fp.likeness(fp.sketch(""), fp.sketch(a)) == 0.0


def test_merged_fingerprint_is_that_of_all_shingles(spark):
    parts = [" ".join(f"w{k * i % 977}" for i in range(1500)) for k in (1, 2, 3)]
    prints = fp.fingerprints(documents(spark, dict(enumerate(parts)))).selectExpr("1 AS grp", "fingerprint")
    merged = fp.merge(prints, "grp").collect()[0]["fingerprint"]
    every = np.unique(np.concatenate([fp.from_text(fp.to_text(fp.sketch(p))) for p in parts]))
    below = every[every < fp.LIMIT]
    assert merged == fp.to_text(below if len(below) >= fp.FLOOR else every[: fp.FLOOR])


def test_awkward_rows(spark):
    rows = fp.compare_with_next(awkward(spark)).collect()
    assert len(rows) == 11
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_chars"] == 0 and by_id[2]["fingerprint"] == "" and by_id[2]["near_next"] == 1.0
    assert by_id[7]["fingerprint"] == by_id[8]["fingerprint"] and by_id[7]["near_next"] == 1.0
    assert fp.compare_with_next(awkward(spark, empty=True)).count() == 0
    single = fp.compare_with_next(documents(spark, {4: "only one document"})).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
