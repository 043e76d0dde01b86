from __future__ import annotations

import random
import re

import numpy as np

from attesta.llm import neardup
from tests.llm.fixtures import awkward, documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def made_texts():
    """Groups of edited copies, among them chains whose ends are not alike, and copies of one text."""
    draw = random.Random(2)
    texts, k = {}, 1000
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([4, 12, 60, 200]))]
        for _ in range(draw.randint(1, 9)):
            k -= 7
            texts[k] = " ".join(w.upper() if draw.random() < 0.1 else w for w in words)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"z{draw.randrange(10**6)}"
    texts |= {2000: None, 2001: "", 2002: "\t", 2003: "a b", 2004: "A B", 2005: "a b c"}
    return texts


def test_classes_equal_brute_force(spark):
    texts = made_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(1)
    for like in (0.2, 0.5, 0.8):
        shared, own = draw.integers(1, 2**63, 1000).astype(np.uint64), draw.integers(1, 2**63, (2, round(500 * (1 - like) / like))).astype(np.uint64)
        a, b = np.concatenate((shared, own[0])), np.concatenate((shared, own[1]))
        ra, rb = neardup.registers(a), neardup.registers(b)
        assert (neardup.merge(ra, rb) == neardup.registers(np.concatenate((a, b)))).all()
        found = neardup.likelihood_estimate(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(found - 1000 / (1000 + 2 * own.shape[1])) < 0.17


def test_awkward_rows(spark):
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(awkward(spark)).collect())
    assert rows == [(-1, 3, None, False), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 3, 1, False), (6, 3, 1, False), (7, 4, 7, True), (8, 4, 7, False), (9, 6, 9, True)]
    kept = neardup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 9]
    assert neardup.classes(awkward(spark, empty=True)).count() == 0


def test_two_texts_under_one_id_link_what_each_is_like(spark):
    words = lambda c, n, last: " ".join(f"{c}{i}" for i in range(n)) + f" {last}"
    rows = [(4, words("a", 60, "p")), (9, words("a", 60, "q")), (9, words("b", 60, "q")), (7, words("b", 60, "r")), (8, words("c", 60, "r")), (8, "tiny"), (3, "tiny")]
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (4, 4), (7, 4), (8, 3), (8, 3), (9, 4), (9, 4)]


def test_short_texts_are_never_compared(spark):
    texts = spark.range(100_000).selectExpr("id AS doc_id", "concat_ws(' ', slice(array(concat('w', id), 'x', 'y', 'z'), 1, CAST(id % 4 + 1 AS INT))) AS text")
    signed = neardup.signatures(texts)
    assert signed.agg({"n_shingles": "max"}).first()[0] < neardup.LEAST_BANDED
    rows = neardup.classes(texts)
    assert rows.where("kept AND component_id = doc_id AND n_shingles = 1").count() == 100_000


def test_small_registers_differ():
    draw = np.random.default_rng(4)
    sketches = [neardup.registers(draw.integers(1, 2**63, 3).astype(np.uint64)) for _ in range(300)]
    assert min(int(s.min()) for s in sketches) > 0
