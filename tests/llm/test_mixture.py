from __future__ import annotations

import random

import pytest

from attesta.llm import mixture
from tests.llm.fixtures import awkward


def water_filled(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = whole - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    draw = random.Random(seed)
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)), draw.choice(["a", "b", "c", "d", "é", None]) if draw.random() < 0.7 else "b") for i in range(600)]
    rows += [(1000, "tiny source", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water_filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, len(t.split())) for i, t, _ in rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixture.mix(docs.repartition(3)).collect()))


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixture.mix(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == [(-1, 7), (1, 7), (2, 0), (3, 0), (4, 0), (5, 1), (6, 7), (6, 7), (7, 80_000), (8, 80_000), (9, 10)]
    out = mixture.apply(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixture.mix(awkward(spark, empty=True)).count() == 0
