"""Exact top-k search by inner product: MaxScore over blocks of vectors.

Each dimension is a term. In a block of vectors a term's bound is the most it can add to a query's score
above its least contribution. Terms whose bounds together cannot lift a vector over the query's k-th best
score are non-essential: the postings of the essential terms are added up first, and the others are
probed, largest bound first, only for vectors that can still compete. Blocks are merged by rank.

Queries and candidates meet block by block: every pair of a query block and a candidate block is one
task of fixed size, so neither side is sent whole to any task.

Cases: vectors that are null, or hold null or non-finite components, and rows without id take no part;
shorter vectors count as filled up with zeros; a repeated query id is asked once, with its smallest
vector; a query never finds rows with its own id; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 8192
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v: floor(1024 * x) of each component, as long."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * 1024.0))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        level = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= level)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def max_score(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, start: tuple[np.ndarray, np.ndarray], k: int):
    """Ids and scores of the best k rows of a block, given those found before."""
    one, other = query * low, query * high
    least, most = np.minimum(one, other), np.maximum(one, other)
    order = np.argsort(least - most, kind="stable")
    have_scores, have_ids = start
    level = have_scores[k - 1] if len(have_scores) >= k else None
    after = np.concatenate((np.cumsum(most[order][::-1])[::-1], [0]))
    if level is None:
        essential = len(order)
    else:  # the longest tail of terms that cannot carry a row over the level when the others add their least
        before = np.concatenate(([0], np.cumsum(least[order])))
        essential = int(np.argmax(before + after < level)) if (before + after < level).any() else len(order)
    partial = query[order[:essential]] @ postings[order[:essential]]
    alive = np.flatnonzero(ids != own)
    at = essential
    while level is not None:
        alive = alive[partial[alive] + after[at] >= level]
        if at == len(order) or not len(alive):
            break
        step = order[at : at + 8]
        partial[alive] += rows[np.ix_(alive, step)] @ query[step]
        at += len(step)
    scores = np.concatenate((have_scores, partial[alive]))
    found = np.concatenate((have_ids, ids[alive]))
    top = best(scores, found, k)
    return scores[top], found[top]


def search_block(queries: pa.Table, candidates: pa.Table, k: int, block: int = 2048) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    width = max(queries.column("v").combine_chunks().value_lengths().to_numpy().max(), candidates.column("v").combine_chunks().value_lengths().to_numpy().max())
    q, c = _matrix(queries.column("v"), int(width)), _matrix(candidates.column("v"), int(width))
    largest = float(np.abs(q).astype(float).max(initial=0)) * float(np.abs(c).astype(float).max(initial=0)) * max(width, 1)
    if largest < EXACT:  # sums of products are then exact as doubles, which multiply faster
        q, c = q.astype(np.float64), c.astype(np.float64)
    ids = candidates.column("vec_id").to_numpy()
    state = [(np.zeros(0, q.dtype), np.zeros(0, np.int64)) for _ in range(len(q))]
    own = queries.column("vec_id").to_numpy()
    for at in range(0, len(c), block):
        rows = c[at : at + block]
        postings, low, high = np.ascontiguousarray(rows.T), rows.min(axis=0), rows.max(axis=0)
        for i in range(len(q)):
            state[i] = max_score(q[i], own[i], ids[at : at + block], rows, postings, low, high, state[i], k)
    sizes = [len(s) for s, _ in state]
    return pa.table(
        {
            "query_id": pa.array(np.repeat(own, sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i in state]), pa.int64()),
            "score": pa.array(np.concatenate([s for s, _ in state]).astype(np.int64), pa.int64()),
        }
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates with the largest inner product with each query."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_query = max(1, -(-asked.count() // QUERY_BLOCK))
    n_candidate = max(1, -(-candidates.count() // CANDIDATE_BLOCK))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).cast("int")).withColumn("cb", every(n_candidate))
    right = candidates.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_candidate)).cast("int")).withColumn("qb", every(n_query))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, k)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
