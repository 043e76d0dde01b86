"""A Merkle manifest of a dataset, built by aligned appends with incremental witnesses.

Every row is a leaf; the leaves of a source, by doc_id, are one tree, and the roots of the sources' trees,
by source, are the leaves of the top tree. `arity` consecutive nodes have one parent.

A tree is built in tiers. The nodes of a tier are cut into aligned blocks of arity**LEVELS consecutive
ones. A block is an append-only stream (`append`): a node that arrives joins the open run of the lowest
level with an empty witness; when a run is complete, every member's witness is extended by its siblings
and the run's digest is appended one level up. What is still open when a block ends is closed. Blocks run
in parallel, and their roots are further appends: the nodes of the next tier. In the end each node's
witness is its own, extended by that of its block, and so on up to the root.

A complete block never changes. `extend` appends later rows to a kept manifest and builds anew only the
last, open block of each tree and tier.

Cases: nulls are encoded as `-` and differ from empty strings; a null source is a tree of its own and the
first; rows without doc_id come first in their source; rows that agree in source and doc_id are ordered by
leaf, and repeated rows are leaves of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import tables

ARITY = 3
#: A block is a complete subtree of this height.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _said(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; `changed` puts other values in place of columns."""
    return F.sha2(F.concat(*[_said((changed or {}).get(f, F.col(f))) for f in FIELDS]), 256)


def tree() -> Column:
    """Name of a source's tree; sorts as sources do, null first."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def append(digests: list[str], arity: int, levels: int | None) -> tuple[str, list[list[str]], list[list[str]]]:
    """Append nodes one by one; the root, and for each node its left and right siblings by level.

    `levels` is the height to close to; without it the tree is closed when one node remains.
    """
    left: list[list[str]] = [[] for _ in digests]
    right: list[list[str]] = [[] for _ in digests]
    open_runs: list[list[tuple[str, int, int]]] = [[]]

    def complete(level: int) -> None:
        run = open_runs[level]
        for i, (_, start, end) in enumerate(run):
            before, after = "".join(d for d, _, _ in run[:i]), "".join(d for d, _, _ in run[i + 1 :])
            for node in range(start, end):
                left[node].append(before)
                right[node].append(after)
        if level + 1 == len(open_runs):
            open_runs.append([])
        open_runs[level] = []
        open_runs[level + 1].append((hashlib.sha256("".join(d for d, _, _ in run).encode()).hexdigest(), run[0][1], run[-1][2]))

    for i, digest in enumerate(digests):
        open_runs[0].append((digest, i, i + 1))
        level = 0
        while len(open_runs[level]) == arity:
            complete(level)
            level += 1
    level = 0
    while level < levels if levels is not None else sum(map(len, open_runs)) > 1:
        if open_runs[level]:
            complete(level)
        level += 1
    return next(run[0][0] for run in reversed(open_runs) if run), left, right


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """`nodes` (tree, pos, digest, tall, others) with left, right and root of their block; `tall` trees have more than a block's nodes."""
    made = T._parse_datatype_string("left array<string>, right array<string>, root string")
    schema = T.StructType([*nodes.schema.fields, *made.fields])
    names = nodes.columns

    def build(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("pos").select(names)
        tall = block.column("tall")[0].as_py()
        root, left, right = append(block.column("digest").to_pylist(), arity, levels if tall else None)
        many = pa.list_(pa.string())
        for name, values in (("left", pa.array(left, many)), ("right", pa.array(right, many)), ("root", pa.array([root] * len(left)))):
            block = block.append_column(name, values)
        return block

    # One key made of both: rows that lie by tree must be dealt anew, or all blocks of a large tree would be one task's.
    block_key = F.concat(F.floor(F.col("pos") / arity**levels).cast("string"), F.lit(":"), F.col("tree"))
    return nodes.groupBy(block_key.alias("_block")).applyInArrow(build, schema)


@dataclass
class Manifest:
    """Kept tiers, lowest first (tree, pos, digest, tall, left, right, root; the lowest with doc_id and carried columns), and the top tree's."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    arity: int
    levels: int

    @property
    def size(self) -> int:
        return self.arity**self.levels

    def subroots(self) -> DataFrame:
        """tree and root of each source's tree."""
        found = [t.where("NOT tall AND pos = 0").select("tree", "root") for t in self.tiers]
        return _union(found)

    def root(self) -> DataFrame:
        return _union([t.where("NOT tall AND pos = 0").select("root") for t in self.top])

    def witnessed(self) -> DataFrame:
        """The lowest tier with witnesses up to the root of the top tree, and columns subroot and root."""
        sources = _paths(self.top, self.size, None).join(F.broadcast(self.root().withColumnRenamed("root", "_root")))
        subroots = self.subroots().select("tree", F.col("root").alias("subroot"))
        upper = sources.select(F.col("name").alias("tree"), "left", "right", "_root").join(subroots, "tree")
        lowest = _paths(self.tiers, self.size, upper)
        return lowest.drop("digest", "tall", "root", "pos").withColumnRenamed("_root", "root")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _paths(tiers: list[DataFrame], size: int, upper: DataFrame | None) -> DataFrame:
    """The lowest tier with each witness extended by those of the blocks above it, then by `upper` (tree, left, right, others)."""
    above: DataFrame | None = None
    for tier in reversed(tiers):
        rows = tier.withColumn("_block", F.floor(F.col("pos") / size))
        ends = None if upper is None else upper.withColumn("_block", F.lit(0).cast("long"))
        if above is not None:
            carried = [] if upper is None else [c for c in upper.columns if c not in ("tree", "left", "right")]
            tall = above.select("tree", F.col("pos").alias("_block"), "left", "right", *carried)
            low = tier.where("NOT tall AND pos = 0").select("tree")
            if ends is None:
                ends = low.select("tree", F.lit(0).cast("long").alias("_block"), *[F.array().cast("array<string>").alias(c) for c in ("left", "right")])
            else:
                ends = ends.join(low, "tree", "left_semi")
            ends = tall.unionByName(ends)
        if ends is None:
            above = rows.drop("_block")
            continue
        ends = ends.withColumnRenamed("left", "_left").withColumnRenamed("right", "_right")
        above = rows.join(ends, ["tree", "_block"]).withColumn("left", F.concat("left", "_left")).withColumn("right", F.concat("right", "_right")).drop("_left", "_right", "_block")
    assert above is not None
    return above


def _grow(old: list[DataFrame], nodes: DataFrame, counts: DataFrame, arity: int, levels: int, what: str) -> list[DataFrame]:
    """Tiers over `nodes` (tree, pos, digest, others), which follow the nodes of `old`; `counts` has each tree's number of nodes with them.

    `nodes` may start before the end of the old ones: the nodes of an open block come again.
    """
    size = arity**levels
    most = counts.agg(F.max("n")).first()[0] or 0
    tiers: list[DataFrame] = []
    while True:
        sized = counts.select("tree", (F.col("n") > size).alias("tall"))
        built = _blocks(nodes.join(sized, "tree"), arity, levels)
        before = old[len(tiers)] if len(tiers) < len(old) else None
        if before is not None:
            # Blocks that the new nodes reach are built anew; all others stay as they are.
            fresh = nodes.groupBy("tree").agg(F.min(F.floor(F.col("pos") / size)).alias("_from"))
            stay = before.join(fresh, "tree", "left").where(F.col("_from").isNull() | (F.floor(F.col("pos") / size) < F.col("_from"))).drop("_from")
            # Complete blocks of trees that had one block only become blocks of tall trees; their roots are as high.
            built = stay.drop("tall").join(sized, "tree").select(built.columns).unionByName(built)
        tier = tables.keep(built, what)
        tiers.append(tier)
        if most <= size:
            return tiers
        roots = tier.where(F.col("tall") & (F.col("pos") % size == 0)).select("tree", F.floor(F.col("pos") / size).alias("pos"), F.col("root").alias("digest"))
        if before is None or len(tiers) == len(old):
            nodes = roots
        else:
            # Roots that the next tier does not hold yet: of blocks built anew, and of trees that had no next tier.
            above = old[len(tiers)]
            changed = roots.join(fresh, "tree", "left").join(above.select(F.col("tree").alias("_known")).distinct(), F.col("tree") == F.col("_known"), "left")
            nodes = _reopened(above, changed.where((F.col("pos") >= F.col("_from")) | F.col("_known").isNull()).select(roots.columns), size)
        counts = counts.where(F.col("n") > size).select("tree", F.ceil(F.col("n") / size).alias("n"))
        most = -(-most // size)


def _reopened(old: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """`nodes` with the old nodes that share their first block and come before them."""
    first = nodes.groupBy("tree").agg(F.min("pos").alias("_first"))
    held = old.join(first, "tree").where((F.floor(F.col("pos") / size) == F.floor(F.col("_first") / size)) & (F.col("pos") < F.col("_first")))
    return held.select(nodes.columns).unionByName(nodes)


def _numbered(rows: DataFrame, order: list[Column], what: str) -> DataFrame:
    """Add `_at`, the place of a row among those of its tree, without one task per tree."""
    placed = tables.keep(tables.running_total(rows.withColumn("_one", F.lit(1).cast("long")), [F.col("tree"), *order], {"_at": "_one"}, what), what)
    first = placed.groupBy("tree").agg(F.min("_at").alias("_first"))
    return placed.join(first, "tree").withColumn("_at", F.col("_at") - F.col("_first")).drop("_one", "_first")


def extend(manifest: Manifest | None, docs: DataFrame, arity: int = ARITY, levels: int = LEVELS, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest with `docs` appended; None starts one. `carried` adds columns to the lowest tier.

    Later rows of a source must have greater ids than its earlier ones, or come after them by leaf: an append keeps earlier places.
    """
    columns = carried or {}
    new = tables.keep(docs.select("doc_id", tree().alias("tree"), leaf().alias("digest"), *[c.alias(k) for k, c in columns.items()]), "manifest-leaves")
    nodes = _numbered(new, [F.col("doc_id"), F.col("digest")], "manifest-places").withColumnRenamed("_at", "pos")
    counts = new.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    if manifest is not None:
        arity, levels = manifest.arity, manifest.levels
        held = manifest.tiers[0].groupBy("tree").agg(F.count(F.lit(1)).alias("_held"), F.max("doc_id").alias("_last"))
        late = nodes.where("pos = 0").join(held, "tree").where("doc_id < _last")
        if not late.isEmpty():
            raise ValueError("appended rows must come after the rows of their source")
        nodes = nodes.join(held.drop("_last"), "tree", "left").withColumn("pos", F.col("pos") + F.coalesce("_held", F.lit(0))).drop("_held")
        counts = counts.unionByName(held.select("tree", F.col("_held").alias("n"))).groupBy("tree").agg(F.sum("n").alias("n"))
        nodes = _reopened(manifest.tiers[0], nodes, arity**levels)
    tiers = _grow(manifest.tiers if manifest else [], nodes, counts, arity, levels, "manifest-tier")
    out = Manifest(tiers, [], arity, levels)
    # The top tree has one node a source; its names sort as the sources do.
    subroots = out.subroots().select(F.lit("top").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    named = _numbered(subroots, [F.col("name")], "manifest-sources").withColumnRenamed("_at", "pos")
    out.top = _grow([], named, named.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), arity, levels, "manifest-top")
    return out


def fold(digest: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), digest, lambda at, w: F.sha2(F.concat(w["l"], at, w["r"]), 256))


def proof(left: Column, right: Column) -> Column:
    """The digest of all siblings of a witness, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def tampering_report(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and what a witness says of the row after line feeds of every other doc_id are deleted."""
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False))
    shown = F.when(hit, leaf({"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})).otherwise(leaf())
    rows = extend(None, docs, carried={"leaf": leaf(), "_shown": shown}).witnessed()
    folded = rows.withColumn("folded_root", fold(F.col("_shown"), F.col("left"), F.col("right")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("left"), F.col("right")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_H = " || ".join(
    f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || {f} END" for f in ("doc_id", "source", "lang", "n_chars", "TEXT")
)
SQL = f"""
WITH RECURSIVE tables AS (
  SELECT doc_id, source, sha256({_H.replace('TEXT', 'text')}) AS leaf,
         sha256({_H.replace('TEXT', "replace(text, chr(10), '')")}) AS cut,
         list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN cut ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM tables),
nodes AS (
  SELECT 0 AS level, source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM nodes WHERE n > 1 GROUP BY level, source, pos // {ARITY}),
subs AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, digest, n FROM subs
  UNION ALL
  SELECT level + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY} FROM tops WHERE n > 1 GROUP BY level, pos // {ARITY}),
ways AS (
  SELECT l.doc_id, l.source, l.pos, l.leaf, l.shown, n.level, 0 AS part,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < l.pos // CAST(power({ARITY}, n.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > l.pos // CAST(power({ARITY}, n.level) AS BIGINT)), '') AS after
  FROM leaves l JOIN nodes n ON n.source IS NOT DISTINCT FROM l.source AND n.n > 1 AND n.pos // {ARITY} = l.pos // CAST(power({ARITY}, n.level + 1) AS BIGINT)
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.source, l.pos, l.leaf, l.shown, t.level, 1,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(power({ARITY}, t.level) AS BIGINT)), ''),
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(power({ARITY}, t.level) AS BIGINT)), '')
  FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n > 1 AND t.pos // {ARITY} = s.pos // CAST(power({ARITY}, t.level + 1) AS BIGINT)
  GROUP BY ALL),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY part, level) AS step FROM ways),
proofs AS (
  SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS last FROM steps GROUP BY ALL),
folds AS (
  SELECT source, pos, 0::BIGINT AS step, shown AS digest FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(s.before || f.digest || s.after)
  FROM folds f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.pos = f.pos AND s.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN tops t ON t.n = 1
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
JOIN folds f ON f.source IS NOT DISTINCT FROM l.source AND f.pos = l.pos AND f.step = coalesce(p.last, 0)
"""
