from __future__ import annotations

import hashlib
import random
import re

from attesta.llm import pii
from tests.llm.fixtures import awkward, documents

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    """The contract's patterns as they stand."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(4)
    parts = ["a.b@c.d", "x@y", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (017) 555-7713",
             "+49", "+", "12", " ", "-", "_", "%", "é", "user", "@host.org@other.net", "\n", "00000000000000000000"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + " b@c", "9" * 300_000, "1." * 150_000 + "@", "+1" + "(" * 300_000, "a@" * 100_000):
        pii.base_spans(text)
        list(pii.unknown_spans(text, []))


def bootstrap_texts():
    texts = {i: f"Some prose here. please phone us at +1 (017) 555-77{i:02d} today, thanks number {i}." for i in range(12)}
    texts[50] = "Other prose. please phone us at 0049-555-1234 today, thanks."
    texts[51] = "The serial is AB12345 and the sum of 2024 rows stays."
    return texts


def test_contexts_of_known_numbers_find_unknown_ones(spark):
    rows = {r["doc_id"]: r for r in pii.report(documents(spark, bootstrap_texts())).collect()}
    text = bootstrap_texts()[50]
    at = text.index("0049")
    assert rows[50]["spans"] == f"phone:{at}:{at + 13}" and rows[50]["n_phone"] == 0
    assert rows[51]["spans"] == "" and rows[0]["spans"].count(":") == 2
    assert rows[51]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "[PHONE]" in {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, bootstrap_texts())).collect()}[50]


def test_one_cue_among_varying_neighbours(spark):
    words = "amber birch cedar dogwood elder fir gorse hazel iris juniper kale larch".split()
    texts = {i: f"Some {w} prose. {w} {i} tel: +1 (017) 555-77{i:02d} {w[::-1]} and on." for i, w in enumerate(words)}
    texts[50] = "Quite other text zeppelin tel: 020 7946 0958 whatever follows."
    texts[51] = "In 2024 there were 1234 5678 rows here, and 555 more."
    rows = {r["doc_id"]: r for r in pii.report(documents(spark, texts)).collect()}
    at = texts[50].index("020")
    assert rows[50]["spans"] == f"phone:{at}:{at + 13}" and rows[51]["spans"] == ""
    assert "tel: [PHONE] whatever" in {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}[50]


def test_counts_equal_the_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for r in pii.report(docs).collect():
        spans = plain(text[r["doc_id"]])
        assert [r[f"n_{kind}"] for kind, _ in PATTERNS] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        seen += len(spans)
    assert seen > 50


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = pii.report(docs).collect()
    assert len(rows) == 11
    nine = next(r for r in rows if r["doc_id"] == 9)
    text = next(r["text"] for r in docs.collect() if r["doc_id"] == 9)
    said = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for k, s, e in plain(text))
    assert nine["spans"] == said and nine["n_email"] == 1 and nine["n_phone"] == 1 and nine["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    out = pii.redact(docs)
    assert out.columns == docs.columns
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[9]["text"].endswith("mail me: [EMAIL], or [PHONE]") and by_id[9]["n_chars"] == len(by_id[9]["text"]) and by_id[2]["text"] is None and by_id[9]["_row"] == "r"
    assert pii.report(awkward(spark, empty=True)).count() == 0
