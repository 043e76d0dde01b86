from __future__ import annotations

import hashlib
import zlib

import pytest

from attesta.llm import manifest
from tests.llm.fixtures import awkward


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row):
    return h("".join(said(row[f]) for f in manifest.FIELDS))


def plain_tree(nodes, arity=3):
    """The root and each node's list of (left, right) by level."""
    ways = [[] for _ in nodes]
    level, held = list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        runs = [range(at, min(at + arity, len(level))) for at in range(0, len(level), arity)]
        for run in runs:
            for i in run:
                for leaf in held[i]:
                    ways[leaf].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        held = [[leaf for i in run for leaf in held[i]] for run in runs]
        level = [h("".join(level[i] for i in run)) for run in runs]
    return level[0], ways


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded and verified of every row, as the plain law says."""
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[source] = (own, *plain_tree([plain_leaf(r) for r in own]))
    root, tops = plain_tree([trees[s][1] for s in sources])
    out = []
    for source, top in zip(sources, tops):
        own, subroot, ways = trees[source]
        for row, way in zip(own, ways):
            at = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                at["text"] = row["text"].replace("\n", "")
            folded = plain_leaf(at)
            for left, right in way + top:
                folded = h(left + folded + right)
            out.append((row["doc_id"], plain_leaf(row), subroot, root, h("".join(a + b for a, b in way + top)), folded, folded == root))
    return sorted(out, key=repr)


def made(spark, sizes, start=0):
    rows, doc_id = [], start
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc_id, f"text {doc_id}\nof {source}", "en", source or None, 9))
            doc_id += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def report(spark, kept):
    rows = kept.witnessed().withColumn("p", manifest.proof(manifest.F.col("left"), manifest.F.col("right")))
    return sorted(((r["doc_id"], r["subroot"], r["root"], r["p"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("n", range(1, 30))
def test_appending_a_block_equals_the_plain_tree(n):
    nodes = [h(str(i)) for i in range(n)]
    root, left, right = manifest.append(nodes, 3, None)
    want, ways = plain_tree(nodes)
    assert root == want and [list(zip(a, b)) for a, b in zip(left, right)] == ways


def test_report_equals_the_plain_law(spark):
    docs = made(spark, {"": 1, "a": 2, "b": 30, "c": 9, "é": 4})
    rows = [r.asDict() for r in docs.collect()]
    got = sorted((tuple(r) for r in manifest.tampering_report(docs.repartition(5)).collect()), key=repr)
    assert got == plain(rows) and {r[-1] for r in got} == {True, False}


def test_tiers_equal_one_block(spark):
    docs = made(spark, {"": 1, "a": 3, "b": 40, "c": 10, "d": 9})
    want = report(spark, manifest.extend(None, docs))
    assert report(spark, manifest.extend(None, docs, levels=1)) == want
    assert report(spark, manifest.extend(None, docs, levels=2)) == want


def test_appends_equal_one_build(spark):
    first = made(spark, {"a": 2, "b": 9, "c": 30, "": 1})
    second = made(spark, {"a": 1, "b": 8, "c": 1, "z": 5}, 1000)
    third = made(spark, {"a": 40, "c": 3, "": 3}, 2000)
    kept = manifest.extend(None, first, levels=1)
    for more in (second, third):
        kept = manifest.extend(kept, more)
    want = report(spark, manifest.extend(None, first.unionByName(second).unionByName(third)))
    assert report(spark, kept) == want
    with pytest.raises(ValueError, match="come after"):
        manifest.extend(kept, first)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted((tuple(r) for r in manifest.tampering_report(docs).collect()), key=repr)
    assert got == plain([r.asDict() for r in docs.collect()]) and len(got) == 11
    assert manifest.tampering_report(awkward(spark, empty=True)).count() == 0
