"""Personal data by patterns and by bootstrapped contexts.

Base identifiers (e-mail, ip, card and phone numbers) are found by fixed patterns. They are the seeds of
a bootstrap: the words around an identifier are a lexical pattern, and Spark scores the graph of patterns
and instances in rounds. A pattern is trusted as far as its instances are; an instance that is no base
identifier is trusted as far as its patterns are. Instances that end with enough trust are added.

Candidates for new instances are words with at least MIN_DIGITS digits or an @ that overlap no base
identifier; groups of digits that single spaces join are one candidate. Patterns are the two words before,
the one word before, and one word on either side, so a cue among varying neighbours is a pattern too. Texts are read once; the graph holds only contexts of such words.

Cases: a null text counts as empty, a document without identifiers has the digest of the empty string,
texts are searched whole in linear time, repeated rows get equal results, rows without doc_id are
documents like others, an empty table gives no rows, and other columns are carried only by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import columns, tables

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS = 4
ROUNDS = 3
#: A pattern needs this many different trusted instances and this share of trust among all its instances.
MIN_SUPPORT = 3
MIN_TRUST = 0.6
#: An added instance needs this trust.
MIN_INSTANCE = 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_GROUP = re.compile(r"[0-9()./-]++")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>=|*&%$#"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, so that long words cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", at + 1)


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of all base identifiers, by kind and place."""
    if not _ANY.search(text):
        return []
    found = [(0, *span) for span in emails(text)]
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _passes_luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _plain(word: str) -> str:
    word = word.strip(_EDGE).lower()
    return "#" if _DIGIT.search(word) else word


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: its two words before, the word before, and one word on either side.

    Words that the context's ends cut are left out.
    """
    before = text[max(0, start - 100) : start].split()
    if start > 100 and not text[start - 101].isspace():
        before = before[1:] if text[start - 100 : start - 99].strip() else before
    before = [_plain(w) for w in before[-2:]]
    after = text[end : end + 60].split()
    if len(text) > end + 60 and not text[end + 60].isspace() and text[end + 59 : end + 60].strip():
        after = after[:-1]
    after = [_plain(w) for w in after[:1]]
    if not before or not before[-1]:
        return []
    own = [f"{before[-1]} _"] + ([f"{' '.join(before)} _"] if len(before) > 1 else [])
    return own + ([f"{before[-1]} _ {after[0]}"] if after and after[0] else [])


def unknown_spans(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like words outside the known spans; groups of digits that single spaces join are one."""
    taken = sorted((s, e) for _, s, e in known)
    i = 0
    found: list[tuple[int, int, bool]] = []
    for m in _TOKEN.finditer(text):
        word = m[0]
        if not _ANY.search(word):
            continue
        start = m.start() + len(word) - len(word.lstrip(_EDGE))
        end = m.start() + len(word.rstrip(_EDGE))
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= end or any(s < end and e > start for s, e in taken[i : i + 8]):
            continue
        group = _GROUP.fullmatch(text, start, end) is not None
        if group and found and found[-1][2] and text[found[-1][1] : start] in (" ", ") ", " (", ") ("):
            found[-1] = (found[-1][0], end, True)
        else:
            found.append((start, end, group))
    for start, end, _ in found:
        if "@" in text[start:end] or len(_DIGIT.findall(text, start, end)) >= MIN_DIGITS:
            yield start, end


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_SEEN = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"


def extract(docs: DataFrame, carried: list[str]) -> DataFrame:
    """`carried` columns, a key of the row's id and text, base spans, and all identifiers with their contexts (kind -1: not base)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        for block in columns.blocks(batches, "text", 4 << 20):
            keys, bases, seens = [], [], []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                text = text or ""
                base = base_spans(text)
                spans = base + [(-1, s, e) for s, e in unknown_spans(text, base)] if base or _ANY.search(text) else []
                keys.append(hashlib.blake2b(f"{doc_id}|{text}".encode(), digest_size=16).hexdigest() if spans else None)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                seens.append([{"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "patterns": p} for k, s, e in spans if (p := contexts(text, s, e))])
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in carried], pa.array(keys, pa.string()), pa.array(bases, pa.list_(SPAN)), pa.array(seens, pa.list_(SEEN))], [*carried, "_key", "_base", "_seen"]
            )

    made = T._parse_datatype_string(f"_key string, _base {_SPANS}, _seen {_SEEN}")
    schema = T.StructType([*docs.select(*carried).schema.fields, *made.fields])
    return docs.select(*dict.fromkeys([*carried, "doc_id", "text"])).mapInArrow(each, schema)


def learn(extracted: DataFrame) -> DataFrame:
    """pattern, kind and trust of the accepted patterns: rounds over the graph of patterns and instances."""
    seen = extracted.where(F.size("_seen") > 0).select(F.explode("_seen").alias("s"))
    edges = seen.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind"))
    # One row per pattern and instance; a base identifier is trusted from the start.
    graph = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")).withColumn("trust", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0))
    graph = tables.keep(graph, "pii-graph")
    for _ in range(ROUNDS):
        patterns = tables.keep(score_patterns(graph), "pii-patterns")
        trusted = patterns.withColumnRenamed("kind", "_kind").withColumnRenamed("trust", "_trust")
        voted = graph.where("kind < 0").select("pattern", "value").join(trusted, "pattern")
        instances = voted.groupBy("value", "_kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("_trust"), F.lit(0.999)))))).alias("_trust"))
        best = instances.groupBy("value").agg(F.max(F.struct("_trust", -F.col("_kind"))).alias("_best"))
        best = best.select("value", F.col("_best._trust").alias("_new"), (-F.col("_best.col2")).alias("_as"))
        known = graph.where("kind >= 0").select("pattern", "value", "kind", "trust")
        # An instance takes part as the kind it is trusted as; kinds of unknown ones are kept as -2 - kind.
        unknown = graph.where("kind < 0").select("pattern", "value").join(best, "value", "left")
        unknown = unknown.select("pattern", "value", F.coalesce(-2 - F.col("_as"), F.lit(-1)).alias("kind"), F.coalesce("_new", F.lit(0.0)).alias("trust"))
        graph = tables.keep(known.unionByName(unknown), "pii-graph")
    return score_patterns(graph)


def score_patterns(graph: DataFrame) -> DataFrame:
    """Accepted patterns: the kind most of a pattern's trust lies in, and that trust's share of all its instances."""
    kind = F.when(F.col("kind") >= 0, F.col("kind")).when(F.col("kind") <= -2, -2 - F.col("kind"))
    per_kind = [F.sum(F.when(kind == k, F.col("trust")).otherwise(0.0)).alias(f"_t{k}") for k in range(len(KINDS))]
    counted = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("trust") > 0.5).cast("int")).alias("_trusted"), *per_kind)
    most = F.greatest(*[F.col(f"_t{k}") for k in range(len(KINDS))])
    which = F.coalesce(*[F.when(F.col(f"_t{k}") == most, F.lit(k)) for k in range(len(KINDS))])
    share = most / F.col("_n")
    return counted.where((F.col("_trusted") >= MIN_SUPPORT) & (share >= MIN_TRUST)).select("pattern", which.alias("kind"), share.alias("trust"))


def added_spans(extracted: DataFrame, patterns: DataFrame) -> DataFrame:
    """_key and the spans that accepted patterns add to rows with that key."""
    unknown = extracted.where(F.exists("_seen", lambda s: s["kind"] < 0)).select("_key", F.explode("_seen").alias("s")).where("s.kind < 0").distinct()
    matched = unknown.select("_key", "s.start", "s.end", F.explode("s.patterns").alias("pattern")).join(patterns, "pattern")
    by_kind = matched.groupBy("_key", "start", "end", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))))).alias("trust"))
    best = by_kind.groupBy("_key", "start", "end").agg(F.max(F.struct("trust", -F.col("kind"))).alias("b"))
    sure = best.where(F.col("b.trust") >= MIN_INSTANCE).select("_key", (-F.col("b.col2")).cast("int").alias("kind"), "start", "end")
    return sure.groupBy("_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))


def _may_grow() -> Column:
    """Whether a row holds an unknown identifier in a context, which accepted patterns could add."""
    return F.coalesce(F.exists("_seen", lambda s: s["kind"] < 0), F.lit(False))


def grow(extracted: DataFrame, added: DataFrame) -> DataFrame:
    """The rows with unknown identifiers, their base spans and those added to them as `_all`."""
    joined = extracted.where(_may_grow()).drop("_seen").join(added, "_key", "left")
    return joined.withColumn("_all", F.concat("_base", F.coalesce("_added", F.array().cast(_SPANS)))).drop("_added")


def find(docs: DataFrame, carried: list[str]) -> DataFrame:
    """`carried` columns, `_base` and `_all` spans of every row."""
    kept = tables.keep(extract(docs, carried), "pii-contexts")
    # Only rows with an unknown identifier can be added to; the others stay where they are.
    rest = kept.where(~_may_grow()).drop("_seen").withColumn("_all", F.col("_base"))
    return grow(kept, added_spans(kept, learn(kept))).unionByName(rest).drop("_key")


def _said(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    parts = F.transform(F.array_sort(spans), lambda s: F.concat(name(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans of each kind, digest of the base spans, and all spans as text."""
    found = find(docs, ["doc_id"])
    counts = [_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(F.col("_all")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redacted_block(block: pa.RecordBatch, names: list[str], spans: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    """The columns `names` of a block, its texts without the spans (start, end, kind) of each row, `n_chars` set anew."""
    texts = [t if not s else redacted(t, s) for t, s in zip(block.column("text").to_pylist(), spans)]
    out = {c: block.column(c) for c in names} | {"text": pa.array(texts, block.column("text").type)}
    if "n_chars" in out:
        out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], out["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(out.values()), names)


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; personal data in `text` replaced by its kind, `n_chars` set anew.

    Rows without unknown identifiers, nearly all as a rule, are searched and redacted in one pass. The others are
    kept with the spans added to them and redacted from there, so no task runs two Python steps at once.
    """
    packed = tables.pack(docs, ["doc_id", "text", "n_chars"])
    names = packed.columns
    kept = tables.keep(extract(docs, []), "pii-contexts")
    added = added_spans(kept, learn(kept))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        for block in columns.blocks(batches, "text", 4 << 20):
            found = []
            for text in block.column("text").to_pylist():
                base = base_spans(text or "")
                grows = (bool(base) or _ANY.search(text or "")) and any(contexts(text, s, e) for s, e in unknown_spans(text, base))
                found.append(None if grows else [(s, e, k) for k, s, e in base])
            stays = pa.array([f is not None for f in found], pa.bool_())
            yield _redacted_block(block.filter(stays), names, [f for f in found if f is not None])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        for block in columns.blocks(batches, "text", 4 << 20):
            spans = [[(x["start"], x["end"], x["kind"]) for x in s] for s in block.column("_all").to_pylist()]
            yield _redacted_block(block, names, spans)

    rest = packed.mapInArrow(settled, packed.schema)
    open_rows = grow(extract(packed, names), added).select(*names, "_all")
    return rest.unionByName(tables.keep(open_rows, "pii-open").mapInArrow(grown, packed.schema)).select(*tables.unpack(packed, docs))
