"""Sharding by balanced label propagation, with DataFrame operations only.

Rows with an equal link (here: equal texts) are neighbours. Each linked row starts with a label, the hash of
its id; in each round it asks to move to the label that most of its neighbours have among those with room,
and a shard admits requests, of large groups first, up to its quota. What is left over, and the rows without
neighbours, then fill the shards to their exact capacity.

Rows of one link are alike, so the state is a count per (link, label): a group has at most one row per shard
whatever its size, and rounds join and sum such counts. Rows meet their group again by (link, block of places
within the group), so a group of copies of any size is spread over tasks. Only one number per shard goes to
the driver.

Laws: `rows` gives shards whose numbers of rows are at most one apart; `bytes` gives shards whose sizes differ
by at most about one row's size. A group is cut when it is larger than a shard or finds no room.

Cases: a null text has size 8 and checksum 0 and is linked with other null texts; empty texts are linked with
each other; repeated rows are rows of their own; rows without doc_id are rows like others; an empty table
gives no rows; other columns are not read. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import tables

SHARDS = 24
LAW = "rows"
ROUNDS = 4
#: Places of a group that are joined under one key.
PLACES = 1024
#: What a row costs beside its text, in bytes.
OVERHEAD = 8


def described(docs: DataFrame, law: str) -> DataFrame:
    """doc_id, size, text_crc32, link and unit (what the row takes of a quota) of each row."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    link = F.coalesce(F.unhex(F.sha2(F.col("text"), 256)), F.lit(b""))
    return docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), link.alias("link"), (size if law == "bytes" else F.lit(1).cast("long")).alias("unit"))


def numbered(df: DataFrame, key: str, order: list[Column], name: str, what: str) -> DataFrame:
    """Add `name`, the place of a row among those of its key from 0; rows of one key may lie in many partitions."""
    ranged = df.repartitionByRange(tables.partitions(df.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id())
    kept = tables.keep(ranged, what)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"))
    carried = counts.select("_part", key, F.sum("_n").over(before).alias("_before")).where("_before > 0")
    inside = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)) - 1
    # Only the first key of a partition can have begun in an earlier one: fewer rows than there are partitions.
    joined = kept.withColumn("_in", inside).join(F.broadcast(carried), ["_part", key], "left")
    return joined.withColumn(name, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_in", "_before", "_part")


def _admitted(room: Column, before: Column) -> Column:
    """How many of a row's `c` members fit into what is left of `room`."""
    return F.greatest(F.lit(0), F.least(F.col("c"), F.floor((room - before) / F.col("unit")))).cast("long")


def _ahead(df: DataFrame, target: str, order: list[Column], what: str) -> DataFrame:
    """Add `_ahead`, the units before a row among those of its target."""
    summed = tables.running_total(df.withColumn("_units", F.col("c") * F.col("unit")), [F.col(target), *order], {"_before": "_units"}, what)
    kept = tables.keep(summed, what)
    base = kept.groupBy(target).agg(F.min("_before").alias("_base"))
    # One row per shard.
    return kept.join(F.broadcast(base), target).withColumn("_ahead", F.col("_before") - F.col("_base")).drop("_before", "_base", "_units")


def propagate(state: DataFrame, capacity: DataFrame, rounds: int) -> DataFrame:
    """Rounds of moves over `state` (link, unit, n, label, c); `capacity` has the capacity of each label."""
    for _ in range(rounds):
        loads = state.groupBy("label").agg(F.sum(F.col("c") * F.col("unit")).alias("_load"))
        room = capacity.join(loads, "label", "left").select("label", (F.col("capacity") - F.coalesce("_load", F.lit(0))).alias("room"))
        seen = state.join(F.broadcast(room), "label")
        # A label whose room takes the whole group comes first, then the one with most of its members.
        fits = F.col("room") >= (F.col("n") - F.col("c")) * F.col("unit")
        better = Window.partitionBy("link").orderBy(fits.desc(), F.col("c").desc(), F.xxhash64("link", "label")).rowsBetween(Window.unboundedPreceding, -1)
        target = F.first(F.when(F.col("room") >= F.col("unit"), F.col("label")), ignorenulls=True).over(better)
        asked = seen.withColumn("target", target).where("target IS NOT NULL").drop("room")
        queue = _ahead(asked, "target", [F.col("n").desc(), F.col("link"), F.col("c").desc(), F.col("label")], "shard-queue")
        open_at = room.select(F.col("label").alias("target"), "room")
        moved = tables.keep(queue.join(F.broadcast(open_at), "target").withColumn("c", _admitted(F.col("room"), F.col("_ahead"))).where("c > 0"), "shard-moves")
        if moved.isEmpty():
            break
        gone = moved.select("link", "unit", "n", "label", (-F.col("c")).alias("c"))
        come = moved.select("link", "unit", "n", F.col("target").alias("label"), "c")
        state = tables.keep(state.unionByName(gone).unionByName(come).groupBy("link", "unit", "n", "label").agg(F.sum("c").alias("c")).where("c > 0"), "shard-state")
    return state


def _filled(pool: DataFrame, room: list[int]) -> DataFrame:
    """Deal the members of `pool` (link, unit, n, c), large groups first, to the shards, most room first, each up to its room; link, label and c."""
    turn = sorted(range(len(room)), key=lambda s: (-room[s], s))
    bounds = [sum(room[s] for s in turn[:i]) for i in range(len(room) + 1)]
    names = F.array(*[F.lit(s) for s in turn])
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    shard_of = lambda x: F.size(F.filter(edges, lambda b: b <= x)) - 1
    queued = tables.running_total(pool.withColumn("_units", F.col("c") * F.col("unit")), [F.col("n").desc(), F.col("link")], {"_at": "_units"}, "shard-pool")
    last = F.col("_at") + (F.col("c") - 1) * F.col("unit")
    dealt = queued.withColumn("label", F.explode(F.sequence(shard_of(F.col("_at")), shard_of(last))))
    # Members that start before an edge.
    upto = lambda edge: F.least(F.col("c"), F.ceil(F.greatest(edge - F.col("_at"), F.lit(0)) / F.col("unit")))
    mine = upto(F.get(edges, F.col("label") + 1)) - upto(F.get(edges, F.col("label")))
    return dealt.select("link", F.get(names, F.col("label")).alias("label"), mine.cast("long").alias("c")).where("c > 0")


def assign(rows: DataFrame, shards: int, rounds: int) -> DataFrame:
    """Add `shard` to rows with doc_id, link and unit."""
    spark = rows.sparkSession
    placed = numbered(rows, "link", [F.col("doc_id")], "_pos", "shard-rows")
    start = F.pmod(F.xxhash64("doc_id", "_pos"), F.lit(shards)).cast("int")
    counts = placed.groupBy("link", start.alias("label")).agg(F.count(F.lit(1)).alias("c"), F.max("unit").alias("unit"))
    groups = tables.keep(counts.withColumn("n", F.sum("c").over(Window.partitionBy("link"))), "shard-groups")
    total = groups.agg(F.sum(F.col("c") * F.col("unit"))).first()[0] or 0
    quota = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    capacity = spark.createDataFrame(list(enumerate(quota)), "label int, capacity long")
    state = propagate(groups.where("n > 1"), capacity, rounds)
    # A group keeps its largest part where it is; its other parts, and what is above a shard's capacity, go back to the pool,
    # which deals the members of a group one after another.
    part = F.row_number().over(Window.partitionBy("link").orderBy(F.col("c").desc(), F.xxhash64("link", "label")))
    parts = state.withColumn("_part_no", part)
    rest = parts.where("_part_no > 1").select("link", "unit", "n", "c")
    held = _ahead(parts.where("_part_no = 1").drop("_part_no"), "label", [F.col("n").desc(), F.col("link")], "shard-held").join(F.broadcast(capacity), "label")
    held = tables.keep(held.withColumn("_stay", _admitted(F.col("capacity"), F.col("_ahead"))), "shard-kept")
    loads = {r["label"]: r["load"] for r in held.groupBy("label").agg(F.sum(F.col("_stay") * F.col("unit")).alias("load")).collect()}  # one row per shard
    over = held.select("link", "unit", "n", (F.col("c") - F.col("_stay")).alias("c")).where("c > 0").unionByName(rest).groupBy("link", "unit", "n").agg(F.sum("c").alias("c"))
    pool = over.unionByName(groups.where("n = 1").select("link", "unit", "n", "c"))
    filled = _filled(pool, [q - loads.get(s, 0) for s, q in enumerate(quota)])
    settled = held.select("link", "label", F.col("_stay").alias("c")).where("c > 0").unionByName(filled).groupBy("link", "label").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("link").orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    spans = settled.select("link", F.col("label").alias("shard"), upto.alias("_to"), (upto - F.col("c")).alias("_from"))
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / PLACES), F.floor((F.col("_to") - 1) / PLACES))))
    joined = placed.withColumn("_block", F.floor(F.col("_pos") / PLACES)).join(cut, ["link", "_block"])
    return joined.where("_pos >= _from AND _pos < _to").drop("_pos", "_from", "_to", "_block")


def shard(docs: DataFrame, shards: int = SHARDS, law: str = LAW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot within it, and grown_shard of each row (null: the laws here do not keep rows in place)."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    assigned = assign(described(docs, law), shards, rounds)
    slotted = numbered(assigned, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot", "shard-slots")
    return slotted.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
