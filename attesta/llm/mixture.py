"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is the number of words
its source has sent up to its end, divided by the source's target. All queues are then sorted together
by finish time and the sequence is cut at the total budget, so each source gets its share of any prefix.
A source whose target is above its size is queued again, up to `epochs` times.

Cases: a null text has size 0, a null source is a source of its own that comes last, documents of size
0 are kept and take nothing, repeated rows are documents of their own, an empty table gives no rows,
and columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text", 4 << 20):
            data, offsets = columns.text_bytes(block.column("text"))
            space = columns.is_space(data)
            begins = ~space
            begins[1:] &= space[:-1]
            inner = offsets[:-1][offsets[:-1] < len(data)]
            begins[inner] = ~space[inner]
            total = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("source"), pa.array(np.diff(total[offsets]))], ["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """source, source_size, source_rank and target of each source, and the total budget in words.

    Sources by code point, null last, take `weights` in turn and share the total size by weight. A
    target stops at `epochs` times its source's size; the excess is shared anew. Sorted by that limit
    per weight, the stopped sources are a prefix, so one running total finds the level of the rest.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    by_name = [F.col("source").asc_nulls_last()]
    ranked = tables.running_total(per_source, by_name, {"source_rank": "_one"}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * epochs).withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    levels = tables.keep(tables.running_total(capped, [F.col("_ratio"), F.col("source_rank")], {"_caps": "_cap", "_ws": "_w"}, "mix-levels"), "mix-targets")
    whole = levels.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("weight")).first()
    budget = whole["words"] or 0
    level = (F.lit(budget) - F.col("_caps")).cast("double") / (F.lit(whole["weight"] or 0) - F.col("_ws"))
    found = levels.withColumn("_level", level).where(F.col("_level") <= F.col("_ratio")).agg(F.min_by("_level", F.struct("_ratio", "source_rank")).alias("level")).first()
    share = F.lit(found["level"] if found["level"] is not None else 0.0)
    target = F.least(F.col("_cap").cast("double"), share * F.col("_w"))
    return levels.select("source", "source_size", "source_rank", target.alias("target")), budget


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies of each document."""
    shuffle_key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = word_counts(docs).withColumn("_key", shuffle_key)
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("size")]
    queued = tables.keep(tables.running_total(rows, order, {"_before": "size"}, "mix-rows"), "mix-queue")
    targets, budget = source_targets(queued, weights, epochs)
    base = queued.groupBy("source").agg(F.min("_before").alias("_base"))
    named = targets.join(base, targets["source"].eqNullSafe(base["source"]), "inner").select(targets["source"].alias("_name"), "source_size", "source_rank", "target", "_base")
    joined = queued.join(named, queued["source"].eqNullSafe(named["_name"]), "inner").drop("_name")
    sent = F.col("_epoch") * F.col("source_size") + F.col("_before") - F.col("_base") + F.col("size")
    copies = (
        joined.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .where("target > 0")
        .withColumn("_finish", sent.cast("double") / F.col("target"))
    )
    sequence = [F.col("_finish"), F.col("source_rank"), F.col("_epoch"), F.col("_key"), F.col("size")]
    ahead = tables.running_total(copies, sequence, {"_ahead": "size"}, "mix-copies")
    row = ["doc_id", "source", "size", "source_size", "target"]
    empty = joined.where("NOT target > 0").select(*row, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    fits = F.col("_ahead") + F.col("size") <= F.lit(budget)
    marked = ahead.select(*row, "_key", "_before", F.when(fits, F.col("size")).otherwise(F.lit(0)).alias("_taken"), fits.cast("long").alias("_copy"), "_epoch")
    # Rows that repeat in every column share a queue place only when their size is 0; the number of first epochs tells them apart.
    summed = marked.groupBy(*row, "_key", "_before").agg(F.sum("_taken").alias("_t"), F.sum("_copy").alias("_c"), F.sum(F.when(F.col("_epoch") == 0, 1).otherwise(0)).alias("_n"))
    spread = summed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return spread.select(*row, F.col("_t").cast("long").alias("taken"), F.floor(F.col("_c") / F.col("_n")).cast("long").alias("copies")).unionByName(empty)


def apply(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them, with the columns of `docs`.

    Documents with the same doc_id are one queue entry each; they are told apart by their number of copies.
    """
    taken = mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("_copies")).withColumnRenamed("doc_id", "_taken")
    packed = tables.pack(docs, ["doc_id"])
    joined = packed.join(taken, F.col("doc_id").eqNullSafe(F.col("_taken")), "inner")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*tables.unpack(packed, docs))


SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
queued AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sent FROM sized),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w, {EPOCHS} * source_size AS cap FROM sources),
ordered AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source_rank) AS place FROM weighed),
levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
     / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ordered),
targets AS (
  SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT level FROM levels WHERE level <= ratio ORDER BY place LIMIT 1)) AS target FROM levels),
copies AS (
  SELECT q.*, t.source_size, t.source_rank, t.target, e.epoch, CASE WHEN t.target > 0 THEN CAST(e.epoch * t.source_size + q.sent AS DOUBLE) / t.target END AS finish
  FROM queued q JOIN targets t ON t.source IS NOT DISTINCT FROM q.source, (SELECT unnest(range({EPOCHS})) AS epoch) e),
ahead AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies WHERE finish IS NOT NULL
  UNION ALL SELECT *, NULL FROM copies WHERE finish IS NULL)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(coalesce(sum(size) FILTER (upto <= (SELECT sum(source_size) FROM sources)), 0) AS BIGINT) AS taken
FROM ahead GROUP BY doc_id, size, source_size, target, k, sent
"""
