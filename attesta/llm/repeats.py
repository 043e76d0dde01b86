"""Substring dedup by recompression.

Rounds name neighbouring words, then the names, again: runs of equal names, and pairs whose left name
falls in one half of a per-round partition and whose right name in the other. A name is a hash of what it
stands for, so it is the same in every document without any exchange, and equal passages are cut into equal
symbols but for their edges. For each symbol the words that its making depends on are known.

Every window of 13 words is filed under one symbol that its words alone decide (the longest there
is). Spark groups these symbols, and all symbols of LONG words or more, by name. A long symbol that
a smaller doc_id has too settles all windows inside it at once, so copies of documents cost their symbols
and not their windows. Windows under a shared symbol that nothing settles are compared one by one, by two
independent hashes of their words, of 64 and 32 bits.

Cases: a null text has no words, texts of fewer than 13 words lose nothing, very long texts are cut whole,
repeated rows do not count as each other's earlier document, different texts under one doc_id neither (each
is a document of its own, told apart by a 64-bit hash of the text), rows without doc_id lose nothing and are
no reason for others to lose words, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

WINDOW = 13
#: Rounds whose symbols may stand for a window, and the words of a symbol that may settle windows.
LOCAL_ROUNDS = 3
LONG = 32
MOST_ROUNDS = 64

_U = columns.U64
_BASE2 = _U(0xC2B2AE3D27D4EB4F)
_LEFT, _RIGHT, _RUN, _LENGTH = (_U(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


@dataclass
class Symbols:
    """Symbols in order: name, words [start, end), the words [low, high) their making depends on, and their text."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray

    def take(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.start, self.end, self.low, self.high, self.text)))


def pair_round(s: Symbols, number: int, first: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Name each neighbouring pair of a left and a right symbol; the symbols after it, and which of them are new."""
    left = (columns.mix(s.name ^ columns.mix(np.array([number + 1], np.uint64))) >> _U(63)).astype(bool)
    n = len(left)
    joins = np.zeros(n, bool)
    joins[:-1] = left[:-1] & ~left[1:] & (s.text[:-1] == s.text[1:])
    swallowed = np.zeros(n, bool)
    swallowed[1:] = joins[:-1]
    # A left symbol that stays has looked at its right neighbour, a right one at its left; a text's edge counts as a word outside.
    edge_low, edge_high = first[s.text] - 1, first[s.text + 1] + 1
    next_high, next_low = np.append(s.high[1:], 0), np.append(0, s.low[:-1])
    same_next, same_last = np.append(s.text[1:] == s.text[:-1], False), np.append(False, s.text[1:] == s.text[:-1])
    alone = ~joins & ~swallowed
    high = np.where(joins, next_high, np.where(alone & left, np.where(same_next, next_high, edge_high), s.high))
    low = np.where(alone & ~left, np.where(same_last, next_low, edge_low), s.low)
    at = np.flatnonzero(joins)
    name, end = s.name.copy(), s.end.copy()
    name[at] = columns.mix(s.name[at] * _LEFT + s.name[at + 1] * _RIGHT)
    end[at] = s.end[at + 1]
    keep = ~swallowed
    return Symbols(name, s.start, end, np.minimum(low, s.low), np.maximum(high, s.high), s.text).take(keep), joins[keep]


def run_round(s: Symbols) -> tuple[Symbols, np.ndarray]:
    """Name each run of equal symbols; the symbols after it, and which of them are new."""
    begins = np.ones(len(s.name), bool)
    begins[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, len(begins)))
    name = np.where(count > 1, columns.mix(s.name[at] * _RUN + count.astype(np.uint64) * _LENGTH), s.name[at])
    last = at + count - 1
    return Symbols(name, s.start[at], s.end[last], s.low[at], s.high[last], s.text[at]), count > 1


@dataclass
class Parse:
    """`filed` holds the symbol of the window at each word (0: no window starts there); `long` are the long symbols."""

    words: columns.Words
    hashes: np.ndarray
    filed: np.ndarray
    long: Symbols


def _joined(parts: list[Symbols]) -> Symbols:
    return Symbols(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("name", "start", "end", "low", "high", "text")))


def parse(column: pa.Array) -> Parse:
    found = columns.words(column)
    hashes, first = found.hashes(), found.first
    n = len(hashes)
    number = np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    symbols = Symbols(hashes, number, number + 1, number, number + 1, text)
    levels = [symbols]
    for r in range(LOCAL_ROUNDS):
        symbols, new = pair_round(symbols, r, first)
        levels.append(symbols.take(np.flatnonzero(new)))  # a symbol depends on the fewest words when it is made
    filed = np.zeros(n, np.uint64)
    open_ = number <= (first[text + 1] - WINDOW if n else number)
    # Windows take the longest symbol they decide; only those without any pair in them take a word.
    for level in (_joined(levels[1:]), levels[0]):
        if not open_.any():
            break
        lo = np.maximum(level.high - WINDOW, first[level.text])
        hi = np.minimum(level.low, first[level.text + 1] - WINDOW)
        waiting = np.concatenate(([0], np.cumsum(open_)))
        usable = np.flatnonzero((lo <= hi) & (level.low >= first[level.text]) & (level.high <= first[level.text + 1]))
        usable = usable[waiting[hi[usable] + 1] > waiting[lo[usable]]]
        weight = (np.minimum(level.end - level.start, 255).astype(np.uint64)[usable] << _U(56)) | (level.name[usable] >> _U(8))
        usable = usable[np.argsort(weight, kind="stable")]
        size = hi[usable] - lo[usable] + 1
        places = np.repeat(lo[usable] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        best = np.full(n, -1, np.int64)
        best[places] = np.repeat(usable, size)  # the last of several is the heaviest
        now = open_ & (best >= 0)
        filed[now] = level.name[best[now]] & ~_U(1) | _U(2)
        open_ &= ~now
    long = []
    for r in range(LOCAL_ROUNDS, MOST_ROUNDS):
        before = len(symbols.name)
        for step in (run_round, lambda s, r=r: pair_round(s, r, first)):
            symbols, new = step(symbols)
            grown = np.flatnonzero(new & (symbols.end - symbols.start >= LONG))
            if len(grown):
                long.append(symbols.take(grown))
        if before <= len(first) - 1 or (len(symbols.name) == before and r > LOCAL_ROUNDS + 24):
            break
    return Parse(found, hashes, filed, _joined(long or [symbols.take(np.zeros(0, np.int64))]))


def symbol_rows(docs: DataFrame) -> DataFrame:
    """doc_id, twin (hash of the text), name and check of the symbols that windows are filed under (check 0) and of the long ones (check: a second hash)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text"):
            p = parse(block.column("text"))
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(block.num_rows), p.words.counts)
            change = p.filed > 0
            change[1:] &= (p.filed[1:] != p.filed[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(change)
            second = columns.span_hashes(p.words.hashes(_BASE2), p.long.start, p.long.end, _BASE2)
            name = np.concatenate((p.filed[at], p.long.name | _U(1))).view(np.int64)
            check = np.concatenate((np.zeros(len(at), np.uint64), second)).view(np.int64)
            twins = block.column("twin").to_numpy()
            owner = np.concatenate((text[at], p.long.text))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner], pa.int64()), pa.array(twins[owner]), pa.array(name), pa.array(check)], ["doc_id", "twin", "name", "check"])

    return docs.mapInArrow(each, "doc_id long, twin long, name long, check long")


def _starts(batch: pa.RecordBatch, keys: list[str], shift: int, held) -> tuple[np.ndarray, list[np.ndarray], bool]:
    """Where the groups of a sorted batch begin, their keys, and whether the first goes on from the group in `held`."""
    cols = [batch.column(k).to_numpy() for k in keys]
    cols[-1] = cols[-1] >> shift
    new = np.ones(batch.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new), cols, held is not None and all(c[0] == h for c, h in zip(cols, held[0]))


def behind_smaller(batches: Iterator[pa.RecordBatch], keys: list[str], shift: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch sorted by keys and doc_id, with its rows behind a smaller doc_id of their group.

    The last key counts without its lowest `shift` bits. Only the key and the smallest doc_id of the group a batch ends in are remembered.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, cols, goes_on = _starts(batch, keys, shift, held)
        doc = batch.column("doc_id").to_numpy()
        least = doc[starts].copy()
        if goes_on:
            least[0] = held[1]
        yield batch, doc > np.repeat(least, np.diff(np.append(starts, len(doc))))
        held = (tuple(c[-1] for c in cols), least[-1])


def shared_symbols(docs: DataFrame) -> DataFrame:
    """doc_id, twin and the symbols (name, behind: a smaller doc_id has it too) that several documents have.

    Of a group sorted by doc_id and twin the first document is told once another follows; every other is told as it comes.
    """
    schema = ["doc_id", "twin", "name", "behind"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, cols, goes_on = _starts(batch, ["name", "check"], 0, held)
            doc, twin, name = batch.column("doc_id").to_numpy(), batch.column("twin").to_numpy(), cols[0]
            least, first = doc[starts].copy(), twin[starts].copy()
            told = np.zeros(len(starts), bool)
            if goes_on:
                least[0], first[0], told[0] = held[1:]
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
            other = (doc != least[group]) | (twin != first[group])
            shared = np.logical_or.reduceat(other, starts)
            tell = np.flatnonzero(shared & ~told)
            behind = np.concatenate((doc[other] > least[group[other]], np.zeros(len(tell), bool)))
            rows = [np.concatenate(x) for x in ((doc[other], least[tell]), (twin[other], first[tell]), (name[other], name[starts[tell]]))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(behind)], schema)
            held = (tuple(c[-1] for c in cols), least[-1], first[-1], bool(told[-1] | shared[-1]))

    parts = tables.partitions(docs.sparkSession)
    grouped = symbol_rows(docs).repartition(parts, "name").sortWithinPartitions("name", "check", "doc_id", "twin")
    rows = grouped.mapInArrow(each, "doc_id long, twin long, name long, behind boolean")
    return rows.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("name", "behind")).alias("shared"))


def _ranges(mark: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal marked runs inside a text: starts and ends."""
    edge = np.ones(len(mark) + 1, bool)
    edge[1:-1] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    return (start[mark[start]], end[mark[start]]) if len(mark) else (start[:0], end[:0])


def _spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some [start, end) covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:n] > 0


def open_windows(matched: DataFrame) -> DataFrame:
    """From documents with shared symbols: settled word ranges (until > 0), and windows still to be compared.

    A window has a 64-bit hash, and 32 bits of a second one above its 32-bit place in `tail`.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text"):
            p = parse(block.column("text"))
            n, first = len(p.hashes), p.words.first
            text = np.repeat(np.arange(block.num_rows), p.words.counts)
            own = columns.mix(np.arange(1, block.num_rows + 1, dtype=np.uint64))
            lists = block.column("shared")
            row = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            name = np.array(flat.field("name").to_numpy()).view(np.uint64) + own[row]
            behind = flat.field("behind").to_numpy(zero_copy_only=False)
            long = np.flatnonzero(np.isin((p.long.name | _U(1)) + own[p.long.text], name[behind]))
            start, end = p.long.start[long], p.long.end[long]
            settled = _spread(start, end - WINDOW + 1, n)
            todo = np.flatnonzero((p.filed > 0) & ~settled)
            todo = todo[np.isin(p.filed[todo] + own[text[todo]], name)]
            one = columns.span_hashes(p.hashes, todo, todo + WINDOW)
            two = columns.span_hashes(p.words.hashes(_BASE2), todo, todo + WINDOW, _BASE2)
            begin, stop = _ranges(_spread(start, end, n), text)
            ids = block.column("doc_id").to_numpy()
            owner = np.concatenate((text[todo], text[begin]))
            place = np.concatenate((todo, begin)) - first[owner]
            until = np.concatenate((np.zeros(len(todo), np.int64), stop - first[text[begin]]))
            h1 = np.concatenate((one, columns.mix(columns.mix(ids[text[begin]].view(np.uint64)) + begin.astype(np.uint64)))).view(np.int64)
            high = np.concatenate((two, np.zeros(len(begin), np.uint64))) & ~_U(0xFFFFFFFF)
            tail = (high | place.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner], pa.int64()), pa.array(block.column("twin").to_numpy()[owner]), pa.array(h1), pa.array(tail), pa.array(until)], ["doc_id", "twin", "h1", "tail", "until"])

    return matched.select("doc_id", "twin", "text", "shared").mapInArrow(each, "doc_id long, twin long, h1 long, tail long, until long")


def repeated_words(matched: DataFrame) -> DataFrame:
    """doc_id, twin and the word ranges [place, until) that windows of documents with smaller ids cover."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, later in behind_smaller(batches, ["h1", "tail"], shift=32):
            doc, twin, tail, until = (batch.column(c).to_numpy() for c in ("doc_id", "twin", "tail", "until"))
            place = tail & 0xFFFFFFFF
            found = later | (until > 0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(twin[found]), pa.array(place[found]), pa.array(np.where(until > 0, until, place + WINDOW)[found])], ["doc_id", "twin", "place", "until"])

    parts = tables.partitions(matched.sparkSession)
    grouped = open_windows(matched).repartition(parts, "h1").sortWithinPartitions("h1", F.shiftright("tail", 32), "doc_id")
    ranges = grouped.mapInArrow(each, "doc_id long, twin long, place long, until long")
    return ranges.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("place", "until")).alias("ranges"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (one space between) of every row."""
    # Without a cast both uses of the texts below are one and the same shuffle.
    rows = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("twin"))
    known = rows.where(F.col("doc_id").isNotNull())
    shared = tables.keep(shared_symbols(known), "shared-symbols")
    repeated = repeated_words(known.join(shared, ["doc_id", "twin"]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in columns.blocks(batches, "text", 4 << 20):
            counts, removed, kept = [], [], []
            for text, ranges in zip(block.column("text").to_pylist(), block.column("ranges").to_pylist()):
                words = text.encode("utf-8").split() if text else []
                if ranges:
                    stay = ~_spread(np.array([r["place"] for r in ranges]), np.array([r["until"] for r in ranges]), len(words))
                    left = list(compress(words, stay.tolist()))
                else:
                    left = words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept string"
    nameless = rows.where(F.col("doc_id").isNull()).withColumn("ranges", F.lit(None).cast("array<struct<place:long,until:long>>"))
    return known.join(repeated, ["doc_id", "twin"], "left").unionByName(nameless).mapInArrow(each, schema)


def digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
