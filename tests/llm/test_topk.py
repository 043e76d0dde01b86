from __future__ import annotations

import math
import random

import pytest

from attesta.llm import topk


def brute(rows, queries, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in queries:
        if q in good:
            mine = min(good[q])
            found = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, vs in good.items() if i != q for v in vs)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 64])
def test_search_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    draw = random.Random(1)
    rows = [(i, [draw.choice([0.5, -0.25, draw.gauss(0, 1)]) for _ in range(12)]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 10), (2200, [float("nan")] * 12), (2300, [float("inf")] * 12), (None, rows[3][1]), (2400, [3.0]), (2500, []), (300, rows[300][1])]
    vectors = topk.quantised(spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, v string"))
    got = topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)
    assert sorted(map(tuple, got.collect())) == brute(rows, sorted({i for i, _ in rows if i is not None and i % 100 == 0}))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**i), -1.0]) for i in range(0, 44, 4)]
    vectors = topk.quantised(spark.createDataFrame([(i, [x / 1024 for x in v]) for i, v in rows], "vec_id long, embedding array<double>"))
    got = topk.top_k(vectors.where("vec_id = 16"), vectors, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(40, 2**56 + 1), (36, 2**52 + 1), (32, 2**48 + 1)]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = topk.quantised(spark.createDataFrame([(0, [1.0, 2.0])], schema))
    assert topk.top_k(one, one).count() == 0
    none = topk.quantised(spark.createDataFrame([], schema))
    assert topk.top_k(none, none).count() == 0 and topk.top_k(none, one).count() == 0
