from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from attesta.llm import alignment
from tests.llm.fixtures import LONG, awkward, documents

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return alignment.vocabularies(*FILES)


@pytest.fixture(scope="module")
def tokenizers(vocabulary):
    return alignment.Tokenizers(*vocabulary)


def plain_groups(known, text):
    """Groups of ids (A, B) of a whole text, both libraries called on all of it."""
    if not text:
        return []
    want = b" " + text.encode()
    a = known.a.encode(" " + text, add_special_tokens=False).ids
    b = known.b.encode(text)
    raw_a, raw_b = [known.a_bytes[i] for i in a], [known.b_bytes[i] for i in b]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain(rows):
    known = alignment.Tokenizers(*alignment.vocabularies(*FILES))
    groups = [(i, plain_groups(known, t)) for i, t in rows]
    links = [(i, Counter((a, b) for x, y in own for a in x for b in y)) for i, own in groups]
    counts = Counter(pair for _, own in links for pair in own)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (i, own), (_, pairs) in zip(groups, links):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        best = sum(n for p, n in pairs.items() if counts[p] == most[p[0]])
        out.append((i, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(pairs.values()), best, sum(n * counts[p] for p, n in pairs.items()),
                    hashlib.sha256(said.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


PARTS = ["the", "Haus", " ", "  ", "\n", "\n\n", ".", ",", "'s", "é", "Über", "日本語", "▁", " ", "\u0085", "1234", "<|endoftext|>", "<s>", "\t", "-", "naïve", "\r\n", "😀", "　", "é", "x", "\x00"]


def texts(seed, n, parts=PARTS, most=14):
    draw = random.Random(seed)
    return {i: "".join(draw.choice(parts) + (" " if draw.random() < 0.5 else "") for _ in range(draw.randint(0, most))) for i in range(n)}


def test_whole_texts_equal_both_libraries(vocabulary, tokenizers):
    aligner = alignment.Aligner(*vocabulary)
    for text in texts(1, 3000).values():
        own = plain_groups(tokenizers, text)
        got = next(aligner.closed([b" " + text.encode() if text else b""]))
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        assert (b";".join(got.said).decode() if got.good else "") == said, repr(text)


def test_composition_is_associative(vocabulary):
    aligner = alignment.Aligner(*vocabulary)
    draw = random.Random(2)
    plainer = [p for p in PARTS if p != "▁"]
    for text in texts(3, 400, plainer, 25).values():
        raw = b" " + text.encode()
        places = sorted(draw.randint(0, len(raw)) for _ in range(4))
        pieces = [raw[a:b] for a, b in zip([0, *places], [*places, len(raw)])]
        want = next(aligner.closed([raw]))
        parts = [aligner.of_range(p) for p in pieces]
        left = parts[0]
        for p in parts[1:]:
            left = aligner.compose(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = aligner.compose(p, right)
        tree = aligner.compose(aligner.compose(parts[0], parts[1]), aligner.compose(aligner.compose(parts[2], parts[3]), parts[4]))
        for way in (left, right, tree):
            done = aligner.finished(way)
            assert b";".join(done.said) == b";".join(want.said), repr(text)
            assert done.sizes.tolist() == want.sizes.tolist() and done.pairs.tolist() == want.pairs.tolist() and done.times.tolist() == want.times.tolist()


@pytest.mark.parametrize("span", [40, 1 << 20])
def test_report_equals_brute_force(spark, vocabulary, span):
    rows = texts(5, 150) | {1000: "of the and " * 30, 1001: "of the and " * 30, 1002: "日本語" * 60, 1003: None}
    got = alignment.report(documents(spark, rows).repartition(4), vocabulary, span).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows.items())


def test_awkward_rows(spark, vocabulary):
    docs = awkward(spark)
    got = sorted(map(tuple, alignment.report(docs, vocabulary).collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(got) == 11 and len(LONG) > alignment.RANGE
    assert alignment.report(awkward(spark, empty=True), vocabulary).count() == 0
