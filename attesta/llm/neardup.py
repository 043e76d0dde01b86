"""MinHash near-duplicates with SetSketch registers.

A document's set holds its distinct runs of five words (A-Z lower-cased). Register j keeps the smallest of
pseudo-random exponential values of the set's elements, rounded down on an exponential scale, so sketches
merge by the maximum of their registers and equal registers are as likely as the sets are alike. Documents
that agree in a band of registers are candidates. Their likeness is estimated from all registers by
maximum likelihood, given both set sizes; what remains is confirmed on the full sets.

Equal sets are one node. Sets of one or two shingles reach the threshold with equal sets alone, so they are in no band. In a band bucket every node is first compared with the bucket's hub only, the node
whose buckets hold most others: in a group of copies, most likely what they were copied from. After
components are formed, buckets that still hold several components compare nodes of different components,
first by sketch and then by set, block by block inside tasks that only links leave. So groups of copies cost
their size, and no pair that could join two components is left out.

Cases: null or empty texts, and texts without words, have the empty set and are linked with nothing; a
text with fewer than five words has one run of all of them; rows with the same doc_id count as linked, and
what each of their texts is linked with is linked with all of them; rows without doc_id are linked with nothing, have no component and are not kept; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

SHINGLE = 5
PERCENT = 75
REGISTERS = 128
BANDS, ROWS = 28, 3
#: Base of the registers' scale, the register of the value 1, and the largest register. Values up to exp(4) keep registers of their own.
SCALE = 1.001
OFFSET = 4_000
TOP = 65_535
#: Smaller sets are linked with equal ones only: k of k + 1 elements are 75% from k = 3 on.
LEAST_BANDED = PERCENT // (100 - PERCENT)
#: Estimates below this are not confirmed: five standard deviations of the estimate under the threshold.
LEAST_ESTIMATE = 0.55
#: Shingles of the nodes that one task compares with as many others, about.
BLOCK_SHINGLES = 500_000
#: Nodes of such a block at most, about.
BLOCK_NODES = 4_000

_FACTORS = columns.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * columns.U64(0xD1342543DE82EF95)) | columns.U64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    found = columns.words(column, lower=True)
    hashes, first = columns.sequence_hashes(found.hashes(), found.first, SHINGLE)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(hashes[a:b])


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set; all zero for the empty one."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 512):
        np.minimum(least, (elements[at : at + 512, None] * _FACTORS).min(axis=0), out=least)
    exponential = -np.log1p(-(np.minimum(least.astype(np.float64), 2.0**64 * (1 - 2.0**-53)) + 0.5) / 2.0**64)
    return np.clip(np.floor(OFFSET + 1 - np.log(exponential) / np.log(SCALE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, twin (hash of the text), n_shingles, set_id (equal sets have equal ids; null for the empty set) and registers of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns.release_kept()
        for block in columns.blocks(batches, "text"):
            sizes, ids, sketches = [], [], []
            for elements in shingle_sets(block.column("text")):
                sizes.append(len(elements))
                ids.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
                sketches.append(registers(elements).astype("<u2").tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("twin"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "twin", "n_shingles", "set_id", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text").mapInArrow(each, "doc_id long, twin long, n_shingles long, set_id binary, registers binary")


def likelihood_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeness of pairs of sketches (rows of a and b) that makes their order of registers most likely, given the set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    share_a = size_a / (size_a + size_b)
    share_b = 1 - share_a
    best, best_at = np.full(len(a), -np.inf), np.zeros(len(a))
    most = np.minimum(share_a / share_b, share_b / share_a)
    for step in np.linspace(0, 1, 101):
        like = most * step
        more = -np.log1p(-np.clip(share_a - share_b * like, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
        less = -np.log1p(-np.clip(share_b - share_a * like, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
        same = np.maximum(1 - more - less, 1e-12)
        value = above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + equal * np.log(same)
        better = value > best
        best, best_at = np.where(better, value, best), np.where(better, like, best_at)
    return best_at


def band_rows(nodes: DataFrame) -> DataFrame:
    """node and key of each band of its registers."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("registers"), i * width + 1, F.lit(width)), i))
    return nodes.select("node", F.explode(keys).alias("key"))


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose sketches make it likely enough to look."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("n_shingles").alias(f"size_{n}"), F.col("registers").alias(f"reg_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = both.where(100 * F.least("size_a", "size_b") >= PERCENT * F.greatest("size_a", "size_b"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("reg_a", "reg_b"))
                like = likelihood_estimate(left, right, batch.column("size_a").to_numpy().astype(float), batch.column("size_b").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(like >= LEAST_ESTIMATE))

    return near.mapInArrow(each, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text_a"):
            good = []
            for left, right in zip(shingle_sets(block.column("text_a")), shingle_sets(block.column("text_b"))):
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield block.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(each, "a long, b long")


def _links_in_cell(node, component, size, sketch, chunk, sets, across_chunks: bool) -> list[tuple[int, int]]:
    """Links between nodes of different components in one cell, enough to join all components that links join.

    Sketches are compared first; sets only where they make the threshold likely. Pairs that a link found here
    has joined already are left out.
    """
    order = np.argsort(size, kind="stable")
    node, component, size, sketch, chunk = node[order], component[order], size[order], sketch[order], chunk[order]
    names, label, counts = np.unique(component, return_inverse=True, return_counts=True)
    largest = int(np.argmax(counts))
    root = np.arange(len(names))  # of each component, joined here
    lower = np.searchsorted(100 * size, PERCENT * size, "left")
    upper = np.searchsorted(PERCENT * size, 100 * size, "right")
    found = []
    for x in np.flatnonzero(label != largest):
        a, b = lower[x], upper[x]
        wanted = (root[label[a:b]] != root[label[x]]) & ((label[a:b] == largest) | (np.arange(a, b) > x))
        if across_chunks:
            wanted &= chunk[a:b] != chunk[x]
        others = np.flatnonzero(wanted) + a
        if len(others):
            others = others[(sketch[others] == sketch[x]).sum(axis=1) >= REGISTERS * (LEAST_ESTIMATE - 0.05)]
        if not len(others):
            continue
        like = likelihood_estimate(np.broadcast_to(sketch[x], (len(others), REGISTERS)), sketch[others], np.full(len(others), float(size[x])), size[others].astype(float))
        mine = sets[order[x]]
        for y in others[np.argsort(-like, kind="stable")][: int((like >= LEAST_ESTIMATE).sum())]:
            if root[label[y]] == root[label[x]]:
                continue
            other = sets[order[y]]
            common = int(np.isin(other, mine, assume_unique=True, kind="sort").sum()) if len(other) > 64 else len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * common >= PERCENT * (len(mine) + len(other) - common):
                found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
                root[root == root[label[y]]] = root[label[x]]
    return found


def links_across(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components in the same open bucket.

    Buckets that share nodes form a family. A family is dealt in cells, each two blocks of its nodes with
    BLOCK_SHINGLES or BLOCK_NODES or so each, and every cell is compared where it lies: no pair leaves it but links.
    """
    families = components(members.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "family")
    single = members.select("node", "component").distinct()
    rows = single.join(families, "node").join(nodes.select("node", "n_shingles", "registers"), "node")
    blocks = F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_NODES)
    cells = rows.groupBy("family").agg(F.ceil(blocks).cast("int").alias("cells"))
    rows = rows.join(cells, "family").join(texts, "node")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.withColumn("ci", F.least("chunk", "other")).withColumn("cj", F.greatest("chunk", "other"))
    names = ["family", "ci", "cj", "chunk", "node", "component", "n_shingles"]

    def compare(group: dict[str, list]) -> pa.RecordBatch:
        data = {n: np.concatenate(group[n]) for n in names}
        sketch = np.frombuffer(b"".join(group["registers"]), "<u2").reshape(-1, REGISTERS)
        links = _links_in_cell(data["node"], data["component"], data["n_shingles"], sketch, data["chunk"], group["sets"], bool(data["ci"][0] != data["cj"][0]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        for block in columns.blocks(batches, "text"):
            data = {n: block.column(n).to_numpy() for n in names}
            sketches, sets = block.column("registers").to_pylist(), list(shingle_sets(block.column("text")))
            new = np.ones(block.num_rows, bool)
            new[1:] = np.any([data[n][1:] != data[n][:-1] for n in names[:3]], axis=0)
            edges = [*np.flatnonzero(new), block.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                same = held is not None and all(held[n][-1][-1] == data[n][a] for n in names[:3])
                if held is not None and not same:
                    yield compare(held)
                if not same:
                    held = {n: [] for n in (*names, "registers", "sets")}
                for n in names:
                    held[n].append(data[n][a:b])
                held["registers"] += sketches[a:b]
                held["sets"] += sets[a:b]
        if held is not None:
            yield compare(held)

    parts = tables.partitions(members.sparkSession)
    dealt = rows.select(*names, "registers", "text").repartition(parts, *names[:3]).sortWithinPartitions(*names[:3])
    return dealt.mapInArrow(each, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node with a link.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are linked with
    the smallest it knows. Every round is kept; the last leaves each node linked with its component alone.
    """
    edges = tables.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        met = large.join(lower, F.col("u") == F.col("_u"))
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select(F.col("_u").alias("u"), F.col("m").alias("v")))
        edges = tables.keep(small.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def same_id(usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of each doc_id that stands on several texts."""
    several = usable.groupBy("doc_id").agg(F.min("twin").alias("_low"), F.max("twin").alias("_high")).where("_low < _high").select("doc_id")
    sets = usable.join(several, "doc_id", "left_semi").select("doc_id", "set_id").distinct()
    placed = sets.join(nodes.select("set_id", "node"), "set_id").select("doc_id", "node")
    least = placed.groupBy("doc_id").agg(F.min("node").alias("a"))
    return placed.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a < b")


def smallest_ids(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the smallest doc_id of its component, for every node of a component with links."""
    members = whole.select("node", "component").unionByName(whole.select(F.col("component").alias("node"), "component").distinct())
    least = members.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("_least"))
    return members.join(least, "component").select("node", "_least")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = tables.keep(signatures(docs), "sketches")
    usable = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    per_set = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "twin")).alias("_at"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # Numbers of nodes hold from here on, as the kept table has them; each node names one text by id and hash.
    nodes = tables.keep(per_set.select(F.monotonically_increasing_id().alias("node"), "set_id", "_at.doc_id", "_at.twin", "n_shingles", "registers"), "nodes")
    bands = band_rows(nodes.where(F.col("n_shingles") >= LEAST_BANDED))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tables.keep(bands.join(buckets, "key"), "bands")  # only buckets with several nodes
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = shared.join(central, "node").select("key", "node", "weight")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("hub")).select("key", (-F.col("hub.col2")).alias("hub"))
    starred = tables.keep(shared.select("key", "node").join(hubs, "key"), "stars")
    named = shared.select("node").distinct().join(nodes.select("node", "doc_id", "twin"), "node")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")
    texts = tables.keep(ids.join(named, ["doc_id", "twin"]).dropDuplicates(["doc_id", "twin"]).select("node", "text"), "texts")
    first = starred.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    likely = tables.keep(plausible(first, nodes), "likely-pairs")  # kept, so that no task runs two Python steps at once
    links = tables.keep(confirmed(likely, texts).unionByName(same_id(usable, nodes)), "pairs")
    grouped = components(links)
    labelled = starred.join(grouped, "node", "left").select("key", "hub", "node", F.coalesce("component", "node").alias("component"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("key")
    members = tables.keep(labelled.join(open_keys, "key", "left_semi"), "open-bands")
    more = tables.keep(links_across(members, nodes, texts), "pairs")
    whole = components(links.unionByName(more))
    by_set = nodes.join(smallest_ids(whole, nodes), "node", "left").select("set_id", F.coalesce("_least", "doc_id").alias("_component"))
    joined = usable.select("doc_id", "n_shingles", "set_id").join(by_set, "set_id").select("doc_id", "n_shingles", F.col("_component").alias("component_id"))
    alone = signed.where("NOT (set_id IS NOT NULL AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = joined.unionByName(alone)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay: one document of each component, with all columns of `docs`."""
    dropped = classes(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")
