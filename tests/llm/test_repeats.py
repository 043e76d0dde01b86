from __future__ import annotations

import hashlib
import random

import numpy as np

from attesta.llm import repeats
from tests.llm.fixtures import awkward, documents


def brute(texts):
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    out = {}
    for k, w in words.items():
        stay = np.ones(len(w), bool)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                stay[i : i + 13] = False
        out[k] = (len(w), int((~stay).sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, stay) if y)).hexdigest())
    return out


def made_texts():
    draw = random.Random(11)
    passages = [[f"p{draw.randrange(40)}" for _ in range(draw.choice([12, 13, 14, 30, 70]))] for _ in range(12)]
    texts = {}
    for k in range(90):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice([draw.choice(passages), [f"u{draw.randrange(3)}" for _ in range(draw.randint(1, 40))], ["same"] * draw.randint(1, 60), [f"x{draw.random()}"]])
        texts[k * 3 % 97] = " ".join(words) if k % 4 else "\n\t".join(words)
    texts[500], texts[501] = texts[3], texts[3] + " tail"
    return texts


def test_removed_words_equal_brute_force(spark):
    texts = made_texts()
    want = brute(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.digests(documents(spark, texts)).collect()}
    assert got == want


def test_equal_windows_are_filed_alike(spark):
    import pyarrow as pa

    draw = random.Random(3)
    middle = [f"m{draw.randrange(9)}" for _ in range(40)]
    texts = [" ".join([f"{side}{i}" for i in range(n)] + middle + [f"{side}{i}" for i in range(n + 3)]) for side, n in (("a", 1), ("b", 2), ("c", 7), ("d", 0))]
    p = repeats.parse(pa.array(texts))
    rows = [p.filed[p.words.first[d] + n : p.words.first[d] + n + 28] for d, n in enumerate((1, 2, 7, 0))]
    assert all((r == rows[0]).all() for r in rows) and (rows[0] > 0).all()


def test_awkward_rows(spark):
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in repeats.digests(awkward(spark)).collect())
    assert got[-1] == (9, 10, 0) and (8, 80_000, 80_000) in got and (7, 80_000, 0) in got and (2, 0, 0) in got and (-1, 7, 0) in got and len(got) == 11
    assert repeats.digests(awkward(spark, empty=True)).count() == 0


def test_two_texts_under_one_id(spark):
    long, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, long), (2, "x " + long), (2, other), (2, other), (5, "y " + other + " z"), (6, long + " " + other)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 80, 0), (2, 20, 0), (2, 20, 0), (2, 81, 80), (5, 22, 20), (6, 100, 100)]
