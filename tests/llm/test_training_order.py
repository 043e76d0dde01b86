from __future__ import annotations

import numpy as np
import pytest

from attesta.llm import training_order as order
from tests.llm.fixtures import awkward, documents


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(size):
    got = order.permute(np.arange(size), size)
    assert sorted(got) == list(range(size))
    if size >= 1000:
        assert (got != order.permute(np.arange(size), size, key=1)).mean() > 0.9 and abs(np.corrcoef(got, np.arange(size))[0, 1]) < 0.1


def test_shards_hold_every_token_and_resume(spark):
    texts = {i: f"text {i} " * (i % 40) for i in range(300)}
    docs = documents(spark, texts).repartition(3)
    place = order.write_shards(order.byte_tokens(docs), length=64, rows=50)
    rows = sorted(order.read_shards(spark, place, length=64, rows=50).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and all(len(r["body"]) == 64 and r["offset"] == r["slot"] % 50 * 65 for r in rows)
    stream = b"".join(bytes(r["body"]) for r in rows).replace(bytes([order.PAD]), b"")
    assert stream.count(bytes([order.END])) == 300 and len(stream) == sum(len(t) + 1 for t in texts.values())
    half = len(rows) // 2
    resumed = sorted((r["slot"], bytes(r["body"])) for r in order.read_shards(spark, place, start=half, length=64, rows=50).collect())
    assert resumed == [(r["slot"], bytes(r["body"])) for r in rows[half:]]


def test_stream_of_one_partition_is_whole(spark):
    texts = {1: "é" * 500, 2: "", 3: "abc"}
    made, total = order.sequences(order.byte_tokens(documents(spark, texts).coalesce(1)), 64, 1, b"\xff", b"\xfe", 9)
    by_slot = {r["slot"]: bytes(r["body"]) for r in made.collect()}
    stream = b"".join(by_slot[s] for s in order.permute(np.arange(total), total, 9))
    assert stream.rstrip(b"\xfe") == b"".join(t.encode() + b"\xff" for t in texts.values())


def test_awkward_rows(spark):
    rows = order.described(order.read_shards(spark, order.write_shards(order.byte_tokens(awkward(spark))))).collect()
    assert sum(r["n_ends"] for r in rows) == 11 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert order.described(order.read_shards(spark, order.write_shards(order.byte_tokens(awkward(spark, empty=True))))).count() == 0
