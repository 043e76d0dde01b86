from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from attesta.llm import bpe
from tests.llm.fixtures import awkward

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def content():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(5)
    letters = "  aabcdefghiorstuvw'ABC é日本ñ0123456789.,!?\n\t \u001c😀ёш\0"
    for k in range(600):
        if k % 3 == 0:
            yield draw.choice(letters) * draw.randint(1, 700)
        elif k % 3 == 1:
            yield bytes(draw.randrange(256) for _ in range(60)).decode("utf-8", "replace")
        else:
            yield "".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))


def test_encoding_equals_the_library_and_decodes_back(content, library):
    codec = bpe.Codec(content, public_tokenizers.PATTERN)
    for text in texts():
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert codec.decode(ids) == text


def test_encoding_is_the_same_when_little_is_kept(content, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_MOVES", 50)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    codec = bpe.Codec(content, public_tokenizers.PATTERN)
    for text in ["the quick brown fox jumps", "unbelievable antidisestablishmentarianism", "zz" * 400 + "yx" * 400]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_utf8_machine_takes_any_split_and_marks_wrong_bytes():
    data = "aé日😀".encode()
    for cut in range(len(data) + 1):
        machine = bpe.Utf8Machine()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.finish() == "aé日😀"
    machine = bpe.Utf8Machine()
    assert machine.feed(b"a\xffb\xe2\x82c\xc0\x80") + machine.finish() == "a�b�c��"
    assert machine.feed(b"\xf0\x9f") + machine.finish() == "�"


def test_operators_on_awkward_rows(spark, library):
    ranks = bpe.vocabulary(spark, PATH)
    docs = awkward(spark)
    out = bpe.digests(docs, ranks, public_tokenizers.PATTERN, docs.columns)
    assert sorted(out.columns) == sorted({*docs.columns, "ids_sha256", "decoded_sha256"})
    for row in out.collect():
        ids = library.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    plain = docs.select("doc_id", "text")
    again = bpe.decode(bpe.encode(plain, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert all(r["decoded"] == (r["text"] or "") for r in again.collect())
    assert bpe.digests(awkward(spark, empty=True), ranks, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
