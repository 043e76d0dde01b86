"""Word positions and hashes of whole text columns, computed on the bytes of an Arrow batch with numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values: nearby inputs give unrelated outputs."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown per process."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[key] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=out[1:], dtype=U64)
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; it depends on the content alone, not on its place."""
    n = len(values)
    sums = prefix_sums(values.astype(U64, copy=False) * powers(base, n)) if n else np.zeros(1, U64)
    back = powers(inverse(base), n + 1)
    raw = (sums[ends] - sums[starts]) * back[starts]
    return mix(raw + mix((ends - starts).astype(U64)))


@dataclass
class Words:
    """The words of a block of texts: `start` and `end` are byte positions, `first[d]:first[d + 1]` are the words of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: np.uint64 = BASE) -> np.ndarray:
        return span_hashes(self.data.astype(U64) + U64(1), self.start, self.end, base)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def release_kept() -> None:
    """Free what other operators keep in this worker process; for tasks that do not use it."""
    sys.__dict__.pop("_kept_codecs", None)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte as it is."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal non-zero `kind`, cut at the texts' borders: starts, ends, and the first run of each text."""
    n = len(kind)
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new[offsets] = True
    edges = np.flatnonzero(new)
    if n == 0:
        edges = np.zeros(0, np.int64)
    start, end = edges[:-1], edges[1:]
    if n:
        keep = kind[start] > 0
        start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words are maximal runs of anything but space and the bytes 9 to 13."""
    data, offsets = text_bytes(column)
    if lower:
        data = lowered(data)
    start, end, first = runs((~is_space(data)).astype(np.int8), offsets)
    return Words(data, offsets, start, end, first)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a block hold about `limit` bytes; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def sequence_hashes(word_hashes: np.ndarray, first: np.ndarray, width: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash every run of `width` consecutive words inside a text: the hashes, and the first of each text.

    A text with fewer words, but at least one, gives one hash over all of them.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    start = np.repeat(first[:-1] - begins[:-1], sizes) + np.arange(begins[-1])
    end = np.minimum(start + width, np.repeat(first[1:], sizes))
    return span_hashes(word_hashes, start, end, base), begins
