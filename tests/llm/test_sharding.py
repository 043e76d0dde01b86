from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from attesta.llm import sharding
from tests.llm.fixtures import awkward


def made(spark, groups, singles, seed=1):
    """Groups of copies of the given sizes and so many single texts, dealt at random."""
    draw = random.Random(seed)
    texts = [t for g, n in enumerate(groups) for t in [f"copy {g} " * draw.randint(1, 9)] * n] + [f"single {i} " * draw.randint(1, 40) for i in range(singles)]
    draw.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def shards_of_groups(docs, out):
    text = dict(docs.collect())
    where = defaultdict(Counter)
    for r in out:
        where[text[r["doc_id"]]][r["shard"]] += 1
    return where


def check_rows(docs, out, shards):
    rows = {i: t for i, t in docs.collect()}
    assert sorted(r["doc_id"] for r in out) == sorted(rows)
    slots = defaultdict(list)
    for r in out:
        raw = (rows[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return slots


@pytest.mark.parametrize(("groups", "singles", "shards"), [([2] * 40 + [3] * 20 + [9], 300, 8), ([150, 40, 2, 2], 100, 4), ([5] * 60, 0, 6), ([300], 0, 5), ([], 50, 24), ([7], 3, 24)])
def test_rows_law(spark, groups, singles, shards):
    docs = made(spark, groups, singles)
    out = sharding.shard(docs, shards).collect()
    slots = check_rows(docs, out, shards)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and {r["law"] for r in out} == {"rows"}
    where = shards_of_groups(docs, out)
    cut = [w for w in where.values() if len(w) > 1]
    # With room beside the groups only those larger than a shard are cut; without, a group's largest part stays and the others are dealt together.
    if singles >= 100:
        assert all(sum(w.values()) > min(counts) for w in cut)
    assert all(len(w) <= sum(w.values()) // max(1, min(counts)) + 3 for w in cut)
    again = sharding.shard(docs.repartition(3), shards).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_propagation_cuts_far_fewer_links_than_hashing(spark):
    docs = made(spark, [2] * 100 + [12] * 20 + [200], 500)
    where = shards_of_groups(docs, sharding.shard(docs, 8).collect())
    pairs = lambda c: sum(n * (n - 1) // 2 for n in c.values())
    links = sum(sum(w.values()) * (sum(w.values()) - 1) // 2 for w in where.values())
    together = sum(pairs(w) for w in where.values())
    # At random one link in eight is kept; the group of 200 has more rows than a shard (143).
    assert together > 0.5 * links
    assert all(len(w) == 1 for w in where.values() if sum(w.values()) < 100)


def test_bytes_law(spark):
    docs = made(spark, [2] * 40 + [30, 9], 400)
    out = sharding.shard(docs, 6, law="bytes").collect()
    check_rows(docs, out, 6)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in out)
    assert all(len(w) == 1 for w in shards_of_groups(docs, out).values() if sum(w.values()) > 1)
    with pytest.raises(ValueError, match="law"):
        sharding.shard(docs, 6, law="key")


def test_plan_has_no_python(spark):
    plan = sharding.shard(made(spark, [3, 2], 20), 4)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = sharding.shard(docs, 3).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [3, 4, 4]
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[2]["size"] == 8 and by_id[2]["text_crc32"] == 0 and by_id[7]["shard"] == by_id[8]["shard"] and by_id[1]["shard"] == by_id[None]["shard"]
    assert len({r["shard"] for r in out if r["doc_id"] == 6}) == 1
    assert sharding.shard(awkward(spark, empty=True)).count() == 0
