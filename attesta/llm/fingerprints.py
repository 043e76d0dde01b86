"""Document fingerprints: threshold-scaled sketches of character shingles.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so its size follows the
document and sketches of very unequal documents stay comparable. So that short documents have one too,
the FLOOR smallest hashes are always kept. Both rules survive union: the fingerprint of a union is found
from the fingerprints of its parts (`merge`). It is text: the sorted hashes, HEX digits each.

Cases: a null text counts as empty, an empty text has the empty fingerprint, a text shorter than a
shingle is one shingle, repeated rows and equal ids are neighbours in the order of their texts, rows
without id come first, an empty table gives no rows, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import columns, tables

WIDTH = 6
FRACTION = 1 / 64
FLOOR = 64
BITS = 40
HEX = BITS // 4
LIMIT = int((1 << BITS) * FRACTION)


def sketch(text: str) -> np.ndarray:
    """The sorted kept hashes of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + columns.U64(1)
    if not len(codes):
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, len(codes) - WIDTH + 1))
    hashes = columns.span_hashes(codes, start, np.minimum(start + WIDTH, len(codes))) >> columns.U64(64 - BITS)
    below = np.unique(hashes[hashes < LIMIT])
    return below if len(below) >= FLOOR else np.unique(hashes)[: max(FLOOR, len(below))]


def to_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    narrow = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = narrow
    return wide.view(">u8").ravel().astype(np.uint64)


def complete_below(kept: np.ndarray) -> int:
    """Every hash of the document below this bound is in its fingerprint."""
    if len(kept) < FLOOR:
        return 1 << BITS
    return max(LIMIT, int(kept[-1]) + 1)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    bound = min(complete_below(a), complete_below(b))
    a, b = a[a < bound], b[b < bound]
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all shingles of two documents; 1 for two empty ones."""
    both, in_a, in_b = _common(a, b)
    return both / (in_a + in_b - both) if in_a + in_b else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of a that b has too; 1 where a has none."""
    both, in_a, _ = _common(a, b)
    return both / in_a if in_a else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text"):
            texts = [t or "" for t in block.column("text").to_pylist()]
            prints = [to_text(sketch(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def merge(prints: DataFrame, by: str, fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint per value of `by`: that of the union of its documents. No text is read."""
    at = F.sequence(F.lit(0), (F.length(fingerprint) / HEX).cast("int") - 1)
    pieces = F.when(F.length(fingerprint) > 0, F.transform(at, lambda i: F.substring(F.col(fingerprint), i * HEX + 1, F.lit(HEX))))
    single = prints.select(by, F.explode_outer(pieces).alias("_hash")).distinct()
    placed = single.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("_hash").asc_nulls_last())))
    kept = placed.where((F.col("_hash") < F.lit(f"{LIMIT:0{HEX}x}")) | (F.col("_place") <= FLOOR))
    return kept.groupBy(by).agg(F.concat_ws("", F.array_sort(F.collect_list("_hash"))).alias(fingerprint))


def _two_levels(bounds: list[int], key):
    """The number of bounds that are at most `key`, found in two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b <= key))
    fine = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= key)))


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id and sorted; the first row of each range is also sent, marked, behind the range before it.

    So each row meets its successor in its own task. The first of all rows follows the last one. Only
    bounds, one number per partition, pass through the driver.
    """
    spark = docs.sparkSession
    parts = tables.partitions(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("_key", F.array(*[F.lit(s) for s in shares]), F.lit(10_000))).first()[0] if shares else []
    rows = rows.withColumn("_range", _two_levels(sorted(set(found or [])), F.col("_key")).cast("int"))
    firsts = sorted((r["_range"], r["_first"]) for r in rows.groupBy("_range").agg(F.min("_key").alias("_first")).collect())
    ahead = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_before", T.IntegerType())])
    marked = rows.join(F.broadcast(spark.createDataFrame(ahead, schema)), "_key", "left")  # one row per partition at most
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("ahead"))
    copy = F.struct(F.col("_before").alias("range"), F.lit(1).alias("ahead"))
    dealt = marked.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    placed = dealt.select("doc_id", "text", "_key", F.col("_to.range").alias("_range"), F.col("_to.ahead").alias("_ahead"))
    return placed.repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", "_ahead", "_key", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the next one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text edited with the next row's, and its likeness to both."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        ids, out = [], []
        waiting = None
        kind = None

        def finish(doc, text, own, following, other):
            new = edited(text, following)
            changed = sketch(new)
            ids.append(doc)
            out.append((len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), to_text(own), to_text(changed), likeness(own, changed), likeness(own, other)))

        def flush():
            columns_out = [pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]]
            ids.clear(), out.clear()
            return pa.RecordBatch.from_arrays(columns_out, names)

        for block in columns.blocks(batches, "text"):
            kind = block.column("doc_id").type
            rows = zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), block.column("_range").to_pylist(), block.column("_ahead").to_pylist())
            for doc, text, part, ahead in rows:
                if waiting is None and ahead:
                    continue
                own = sketch(text)
                if waiting is not None:
                    finish(*waiting[1:], text, own)
                waiting = None if ahead else (part, doc, text, own)
            if out:
                yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).select("doc_id", "text", "_range", "_ahead").mapInArrow(
        walk, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
