"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, size int, ids binary, n_tokens string, role string, taken int, node long"
LONG = "alpha beta gamma delta " * 20_000


def awkward(spark, empty: bool = False):
    texts = [
        (1, "one two three four five six seven", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", None), (5, "word", "b"),
        (6, "ONE two three four five six seven", "b"), (6, "ONE two three four five six seven", "b"), (7, LONG, "c"), (8, LONG, "c"),
        (None, "one two three four five six seven", "d"), (9, "Grüße 日本語 😀 mail me: jo@example.org, or +1 (017) 555-7713", None),
    ]
    rows = [(i, t, "en", s, None if t is None else len(t), "r", None, 3, b"x", "n", "bad", 1, 5) for i, t, s in ([] if empty else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark, texts: dict[int, str | None], source: str = "s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
