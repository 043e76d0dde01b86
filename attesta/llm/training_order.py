"""Training-order materialisation of token sequences.

Documents become one stream of tokens per input partition, cut into sequences of fixed length. A keyed
Feistel network with cycle-walking permutes the numbers of all sequences: each gets its own slot of the
training order. Slots are dealt by range, and every range writes shards of fixed stride, so slot s lies in
shard s // SHARD_ROWS at byte (s % SHARD_ROWS) * stride, and a run resumes anywhere by arithmetic.

Tokens are the bytes of the text, with two values that UTF-8 never uses for the end of a document and for
padding, so a token takes one byte. Other vocabularies: give `tokens` a binary column with `width` bytes
for each token and a matching end and pad.

Sequence numbers come from the sizes of the input partitions, counted in a first pass over the same scan;
the second pass checks them and stops if the scan was dealt differently.

Cases: a null text counts as empty and leaves its end mark only; long documents span sequences; repeated
rows are written as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import columns, tables

END, PAD = 0xFF, 0xFE
LENGTH = 2048
SHARD_ROWS = 2048
KEY = 20_240_501
FEISTEL_ROUNDS = 6


def permute(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 ... size - 1: balanced Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = columns.mix(np.arange(FEISTEL_ROUNDS, dtype=np.uint64) + columns.mix(np.array([key], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (columns.mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def byte_tokens(docs: DataFrame) -> DataFrame:
    return docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("tokens"))


def sequences(tokens: DataFrame, length: int, width: int, end: bytes, pad: bytes, key: int) -> tuple[DataFrame, int]:
    """slot, n_tokens (without padding), n_ends and body of every sequence, and their number."""
    per_part = tokens.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("tokens") + width).alias("bytes"))
    sizes = {r["part"]: r["bytes"] for r in per_part.collect()}  # one row per input partition
    size = length * width
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += -(-sizes[part] // size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, seen, rest = base.get(part, 0), 0, b""

        def flush(stream: bytes) -> pa.RecordBatch:
            nonlocal number
            full = [stream[i : i + size] for i in range(0, len(stream), size)]
            used = [len(s) // width for s in full]
            ends = [int((np.frombuffer(s, np.uint8).reshape(-1, width) == np.frombuffer(end, np.uint8)).all(axis=1).sum()) for s in full]
            full = [s + pad * (length - n) for s, n in zip(full, used)]
            slots = permute(np.arange(number, number + len(full)), total, key)
            number += len(full)
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(used, pa.int64()), pa.array(ends, pa.int64()), pa.array(full, pa.binary())], ["slot", "n_tokens", "n_ends", "body"])

        for block in columns.blocks(batches, "tokens"):
            data = [rest]
            for body in block.column("tokens").to_pylist():
                data += [body, end]
            stream = b"".join(data)
            seen += len(stream) - len(rest)
            whole = len(stream) // size * size
            rest = stream[whole:]
            if whole:
                yield flush(stream[:whole])
        if rest:
            yield flush(rest)
        if seen != sizes.get(part, 0):
            raise RuntimeError("the input was dealt differently in the second pass; run again")

    return tokens.mapInArrow(cut, "slot long, n_tokens long, n_ends long, body binary"), total


def write_shards(tokens: DataFrame, length: int = LENGTH, width: int = 1, end: bytes = bytes([END]), pad: bytes = bytes([PAD]), key: int = KEY, rows: int = SHARD_ROWS) -> str:
    """Write shard=N/ folders with one file each to the shared folder and return their place.

    A record is a sequence and a line feed: stride = length * width + 1 bytes.
    """
    spark = tokens.sparkSession
    made, total = sequences(tokens, length, width, end, pad, key)
    shards = max(1, -(-total // rows))
    parts = min(tables.partitions(spark), shards)
    # Slots are spread evenly, so equal ranges of shards are equal parts: no sampling, and a shard never spans two.
    shard = F.floor(F.col("slot") / rows)
    dealt = made.withColumn("shard", shard.cast("long")).repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int"))
    place = tables.new_folder(spark, "training-order")
    dealt.sortWithinPartitions("shard", "slot").select("shard", F.col("body").cast("string").alias("value")).write.partitionBy("shard").text(place)
    return place


def read_shards(spark: SparkSession, place: str, start: int = 0, length: int = LENGTH, width: int = 1, rows: int = SHARD_ROWS) -> DataFrame:
    """shard, slot, offset and body of all sequences from slot `start` on; earlier shards are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(place)
    if "shard" not in files.columns:  # no sequence was written
        files = files.withColumn("shard", F.lit(0))
    stride = length * width + 1
    found = files.where(F.col("shard") >= start // rows).select(F.col("shard").cast("long").alias("shard"), "content")
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / stride).cast("int") - 1))
    placed = found.select("shard", at.alias("i"), "content").select(
        "shard", (F.col("shard") * rows + F.col("i")).alias("slot"), (F.col("i").cast("long") * stride).alias("offset"), F.substring("content", F.col("i") * stride + 1, F.lit(length * width)).alias("body")
    )
    return placed.where(F.col("slot") >= start)


def described(read: DataFrame) -> DataFrame:
    """slot, shard, offset, n_tokens, n_ends and sha256 of every sequence, from the written shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            flat = [np.frombuffer(b, np.uint8) for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("slot", "shard", "offset")],
                    pa.array([int((b != PAD).sum()) for b in flat], pa.int64()),
                    pa.array([int((b == END).sum()) for b in flat], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                ],
                ["slot", "shard", "offset", "n_tokens", "n_ends", "sha256"],
            )

    return read.select("slot", "shard", "offset", "body").mapInArrow(each, "slot long, shard long, offset long, n_tokens long, n_ends long, sha256 string")
