"""Alignment of two tokenizers over the same texts by an associative monoid of fragments.

A byte range of a text gives a `Fragment`: an open prefix (bytes before its first cut), closed groups (what
lies between its cuts, tokenized and aligned) and an open suffix. Composing two neighbours closes what the
left one's suffix and the right one's prefix make together; the operation is associative, so the ranges of a
very long text are worked on by many tasks and composed by a tree of Spark reductions. A text of at most one
range is closed where it is read and is not shuffled.

A cut is a single space or line feed between two visible characters. No token of either tokenizer crosses it:
the byte-level one starts a new piece there, and no piece of the other holds a space or line feed behind
another character (`Tokenizers` checks that). What lies between two cuts is tokenized alone, and each
distinct segment of a few MB of text once; a worker remembers frequent segments (bounded; results do not depend on it).

Counts of linked ids are taken over documents packed in blocks: a block's distinct pairs are counted once,
joined with the corpus's counts, and sent back to the block, so what is shuffled follows the distinct pairs
of blocks and not the occurrences. A pair that all documents share is one row per block.

Cases: null and empty texts and texts that a tokenizer does not reproduce have no tokens and count for no
pair; repeated rows are documents of their own; rows without doc_id are documents like others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import columns, tables

#: Bytes of a range; longer texts are dealt to several tasks.
RANGE = 32 << 10
#: Fragments composed by one step of the tree.
FAN = 8
#: A block of documents holds about as many bytes of text.
BLOCK = 8 << 20
#: Texts aligned in one pass over flat arrays hold about as many bytes.
PASS = 3 << 20
#: In a group with more links, each pair of different ids is counted, not listed.
LARGE_GROUP = 4096


#: A segment of visible ASCII and two-byte letters behind its space or line feed, and how many of them are tokenized together.
_PLAIN = re.compile(rb"[ \n](?:[!-~]|[\xc3-\xdf][\x80-\xbf])+")
TOGETHER = 64
#: So many texts are given to a tokenizer in one call, whose own results take much memory.
AT_ONCE = 256
#: A worker remembers at most about so many segments.
KNOWN = 150_000


@dataclass
class Segments:
    """Distinct segments between cuts: whether their tokens give their bytes, their groups printed, numbers of tokens, groups and links, and linked pairs."""

    good: np.ndarray
    said: list[bytes]
    sizes: np.ndarray
    widths: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    def take(self, chosen: np.ndarray) -> Segments:
        wide = self.widths[chosen]
        place = np.repeat((np.cumsum(self.widths) - self.widths)[chosen] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        return Segments(self.good[chosen], [self.said[i] for i in chosen.tolist()], self.sizes[chosen], wide, self.pairs[place], self.times[place])

    def with_more(self, more: Segments) -> Segments:
        arrays = {f: np.concatenate((getattr(self, f), getattr(more, f))) for f in ("good", "sizes", "widths", "pairs", "times")}
        return Segments(said=self.said + more.said, **arrays)


@dataclass
class Fragment:
    """A byte range; `has_cut` tells whether it holds a cut: without one all its bytes are `prefix`."""

    prefix: bytes = b""
    has_cut: bool = False
    suffix: bytes = b""
    said: list[bytes] = field(default_factory=list)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    good: bool = True


def vocabularies(byte_file: str, piece_file: str) -> tuple[str, bytes]:
    """The contents of both vocabulary files, read once by the driver: bounded by the size of a vocabulary."""
    with open(byte_file, encoding="utf-8") as a, open(piece_file, "rb") as b:
        return a.read(), b.read()


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            # Entries in other letters are special tokens, which texts do not give.
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        for piece in pieces:
            if "▁" in piece.lstrip("▁") or "\n" in piece:
                raise ValueError(f"a piece crosses a cut: {piece!r}")
        self.space = self.b.piece_to_id("▁")
        self.marked = [b"%d%s" % (i, mark) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (b",", b"|", b";")]
        self.a_lengths, self.b_lengths = (np.array([len(k) for k in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.marked_lengths = np.array([len(m) for m in self.marked], np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both tokenizers for texts that start with a space or line feed."""
        if len(texts) > AT_ONCE:
            parts = [self.tokens(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
            return [x for p in parts for x in p[0]], [y for p in parts for y in p[1]]
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        # The piece tokenizer puts a space before its input: the one that a text starts with, or one that goes again.
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        b = [y if t[0] == " " else y[1:] if y[:1] == [self.space] else [] for t, y in zip(texts, b)]
        return [np.array(x.ids, np.int32) for x in a], [np.array(y, np.int32) for y in b]

    def sides(self, raw: list[bytes]) -> list[_Side]:
        """The tokens of each segment. Plain segments are tokenized many at a time: between any two of them is a cut."""
        plain = [i for i, r in enumerate(raw) if _PLAIN.fullmatch(r)]
        runs = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        other = sorted(set(range(len(raw))).difference(plain))
        made = self.tokens([b"".join([raw[i] for i in run]).decode() for run in runs] + [raw[i].decode() for i in other])
        order = np.array([*plain, *other], np.int64)
        widths = np.array([len(raw[i]) for i in order], np.int64)
        out = []
        for lists, known, lengths in zip(made, (self.a_bytes, self.b_bytes), (self.a_lengths, self.b_lengths)):
            ids, counts = _flat(lists)
            upto = np.concatenate(([0], np.cumsum(lengths[ids])))
            ends, wanted = upto[1 : 1 + int(counts[: len(runs)].sum())], np.cumsum(widths[: len(plain)])
            places = np.searchsorted(ends, wanted)
            if len(plain) and not (len(ends) and ends[-1] == wanted[-1] and (ends[places] == wanted).all()):
                return self._one_by_one(raw)
            of_each = np.concatenate((np.diff(places + 1, prepend=0), counts[len(runs) :]))
            out.append(_Side(ids, of_each, known, lengths).ordered(order))
        return out

    def _one_by_one(self, raw: list[bytes]) -> list[_Side]:
        made = self.tokens([r.decode() for r in raw])
        return [_Side(*_flat(made[0]), self.a_bytes, self.a_lengths), _Side(*_flat(made[1]), self.b_bytes, self.b_lengths)]

    def segments(self, raw: list[bytes]) -> Segments:
        """Tokenize and align segments, all in one pass over flat arrays."""
        sides = self.sides(raw)
        widths = np.array([len(r) for r in raw], np.int64)
        good = np.logical_and.reduce([widths == s.bytes_of_each() for s in sides])
        joined = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
        place = np.repeat(np.flatnonzero(good), widths[good])
        for side in sides:
            side.keep(good)
            good[place[joined != np.frombuffer(b"".join(map(side.known.__getitem__, side.ids.tolist())), np.uint8)]] = False
        for side in sides:
            side.keep(good)
        a, b = sides
        ends_a, ends_b = np.cumsum(a.lengths[a.ids]), np.cumsum(b.lengths[b.ids])
        ends = np.zeros(int(widths[good].sum()) + 1, bool)
        ends[ends_b] = True
        shared = ends_a[ends[ends_a]]
        to_a, to_b = np.searchsorted(ends_a, shared, "right"), np.searchsorted(ends_b, shared, "right")
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        of_group = np.flatnonzero(good)[np.searchsorted(np.cumsum(widths[good]), shared)]
        sizes = np.stack([np.bincount(of_group, w, len(raw)).astype(np.int64) for w in (n_a, n_b, np.ones(len(shared)), n_a * n_b)], axis=1)
        said = self._printed(a, b, to_a, to_b, n_a, n_b)
        printed = iter(said)
        pairs, times, of_pair = _linked(a.ids, b.ids, to_a, to_b, n_a, n_b, of_group)
        return Segments(good, [next(printed) if g else b"" for g in good], sizes, np.bincount(of_pair, minlength=len(raw)), pairs, times)

    def _printed(self, a: _Side, b: _Side, to_a: np.ndarray, to_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """The groups of each good segment as text: an id with the mark behind it is one entry of a table."""
        codes = np.empty(len(a.ids) + len(b.ids), np.int64)
        last_a, last_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = 1, 2
        codes[np.arange(len(a.ids)) + np.repeat(to_b - n_b, n_a)] = a.ids * 3 + last_a
        codes[np.arange(len(b.ids)) + np.repeat(to_a, n_b)] = b.ids * 3 + last_b
        text = b"".join(map(self.marked.__getitem__, codes.tolist()))
        upto = np.concatenate(([0], np.cumsum(self.marked_lengths[codes])))[np.concatenate(([0], np.cumsum(a.counts + b.counts)))].tolist()
        return [text[x : y - 1] for x, y in zip(upto, upto[1:])]


class _Side:
    """The tokens of one tokenizer for a list of segments, flat."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, known: list[bytes], lengths: np.ndarray) -> None:
        self.ids, self.counts, self.known, self.lengths = ids, counts, known, lengths
        self.segments = np.arange(len(counts))

    def ordered(self, order: np.ndarray) -> _Side:
        """The same for segments in their own order; they are held in the order of the numbers `order`."""
        back = np.argsort(order)
        counts = self.counts[back]
        begins = (np.cumsum(self.counts) - self.counts)[back]
        place = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return _Side(self.ids[place], counts, self.known, self.lengths)

    def bytes_of_each(self) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(self.lengths[self.ids])))
        at = np.concatenate(([0], np.cumsum(self.counts)))
        return np.diff(upto[at])

    def keep(self, good: np.ndarray) -> None:
        """Leave out the tokens of segments that are not good."""
        own = good[self.segments]
        self.ids, self.counts, self.segments = self.ids[np.repeat(own, self.counts)], self.counts[own], self.segments[own]


def _flat(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, and the length of each."""
    return np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), np.array([len(x) for x in lists], np.int64)


def _linked(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs, how often each occurs, and its segment, by segment; a large group gives each pair of different ids once."""
    large = n_a * n_b > LARGE_GROUP
    reach = np.repeat(np.where(large, 0, n_b), n_a)
    into = np.repeat(np.repeat(to_b - n_b, n_a) - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
    pairs = (np.repeat(a, reach) << 32) | b[into]
    times, of_pair = np.ones(len(pairs), np.int64), np.repeat(np.repeat(of_group, n_a), reach)
    for g in np.flatnonzero(large).tolist():
        ka, wa = np.unique(a[to_a[g] - n_a[g] : to_a[g]], return_counts=True)
        kb, wb = np.unique(b[to_b[g] - n_b[g] : to_b[g]], return_counts=True)
        pairs = np.concatenate((pairs, ((ka[:, None] << 32) | kb[None, :]).ravel()))
        times = np.concatenate((times, (wa[:, None] * wb[None, :]).ravel()))
        of_pair = np.concatenate((of_pair, np.full(len(ka) * len(kb), of_group[g])))
    if large.any():
        order = np.argsort(of_pair, kind="stable")
        return pairs[order], times[order], of_pair[order]
    return pairs, times, of_pair


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys.astype(np.int64), values.astype(np.int64)
    if (values == 1).all():
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first).astype(np.int64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces and line feeds between visible characters: ASCII or of two bytes from U+00C0 on."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    visible = (data > 32) & (data < 127)
    wide = (data >= 0xC3) & (data <= 0xDF)
    before = visible.copy()
    before[1:] |= wide[:-1]
    blank = (data == 32) | (data == 10)
    inner = blank[1:-1] & before[:-2] & (visible | wide)[2:]
    return np.flatnonzero(inner) + 1


class Aligner:
    """Turns bytes into fragments and composes them; the tokenizers are made when they are first needed."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        self.made: tuple[str, bytes] = (byte_json, piece_model)
        self.tokenizers: Tokenizers | None = None
        self.names = pa.array([], pa.large_binary())
        self.known: Segments | None = None

    def segments(self, names: pa.Array, often: np.ndarray) -> Segments:
        """The segments `names`, which occur `often`: remembered ones, and new ones by the tokenizers."""
        if self.tokenizers is None:
            self.tokenizers = Tokenizers(*self.made)
        if self.known is None:
            self.known = self.tokenizers.segments([])
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = names.take(pa.array(new))
        at[new] = len(self.names) + np.arange(len(new))
        every = self.known.with_more(self.tokenizers.segments(fresh.to_pylist()))
        out = every.take(at)
        # What occurs once in a few MB is not worth its place.
        worth = new[often[new] > 1]
        if len(self.names) + len(worth) > KNOWN:
            self.names, self.known, worth = self.names.slice(0, 0), self.known.take(np.zeros(0, np.int64)), np.flatnonzero(often > 1)
        self.names = pa.concat_arrays([self.names, names.take(pa.array(worth))])
        self.known = self.known.with_more(out.take(worth))
        return out

    def closed(self, texts: list[bytes]) -> Iterator[Fragment]:
        """Fragments of byte strings that start and end at a cut."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts = np.unique(np.concatenate((cuts(data), offsets[:-1][np.diff(offsets) > 0])))
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self.segments(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)))
        first = np.searchsorted(starts, offsets)
        # Numbers of a text are differences of running sums over its segments.
        upto = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(known.sizes[codes], axis=0)))[first]
        usable = np.diff(np.concatenate(([0], np.cumsum(~known.good[codes])))[first]) == 0
        # Pairs of a text: sort (text, pair), the pairs numbered within this call.
        distinct, number = np.unique(known.pairs, return_inverse=True)
        wide = known.widths[codes]
        place = np.repeat((np.cumsum(known.widths) - known.widths)[codes] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        of_text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(first)), wide)
        keys, times = summed(of_text * max(len(distinct), 1) + number[place], known.times[place])
        at = np.searchsorted(keys, np.arange(len(texts) + 1) * max(len(distinct), 1))
        pairs = distinct[keys % max(len(distinct), 1)] if len(keys) else keys
        codes_list = codes.tolist()
        for i in range(len(texts)):
            if not usable[i]:
                yield Fragment(has_cut=True, good=False)
            elif first[i] == first[i + 1]:
                yield Fragment(has_cut=True)
            else:
                said = b";".join([known.said[c] for c in codes_list[first[i] : first[i + 1]]])
                yield Fragment(has_cut=True, said=[said], sizes=upto[i + 1] - upto[i], pairs=pairs[at[i] : at[i + 1]], times=times[at[i] : at[i + 1]])

    def of_range(self, raw: bytes) -> Fragment:
        """The fragment of any byte range."""
        at = cuts(np.frombuffer(raw, np.uint8))
        if not len(at):
            return Fragment(prefix=raw)
        out = next(self.closed([raw[at[0] : at[-1]]]))
        out.prefix, out.suffix = raw[: at[0]], raw[at[-1] :]
        return out

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        """The fragment of two neighbouring ranges."""
        if not x.has_cut and not y.has_cut:
            return self.of_range(x.prefix + y.prefix)
        if not x.has_cut:
            # A cut at the border shows only now, so what was open is looked at anew.
            return self._joined(Fragment(has_cut=True), x.prefix + y.prefix, y, open_left=True)
        if not y.has_cut:
            return self._joined(x, x.suffix + y.prefix, Fragment(has_cut=True), open_right=True)
        return self._joined(x, x.suffix + y.prefix, y)

    def _joined(self, x: Fragment, middle: bytes, y: Fragment, open_left: bool = False, open_right: bool = False) -> Fragment:
        """`middle` between the closed groups of x and y; it is closed at both ends unless told otherwise."""
        at = cuts(np.frombuffer(middle, np.uint8))
        start = (at[0] if len(at) else len(middle)) if open_left else 0
        stop = (at[-1] if len(at) else 0) if open_right else len(middle)
        inner = next(self.closed([middle[start:stop]]))
        parts = [x, inner, y]
        pairs, times = summed(np.concatenate([p.pairs for p in parts]), np.concatenate([p.times for p in parts]))
        return Fragment(
            middle[:start] if open_left else x.prefix, True, middle[stop:] if open_right else y.suffix,
            [s for p in parts for s in p.said if s], x.sizes + inner.sizes + y.sizes, pairs, times, all(p.good for p in parts),
        )

    def finished(self, x: Fragment) -> Fragment:
        """The fragment of a whole text: its start and end are cuts."""
        if not x.has_cut:
            return next(self.closed([x.prefix]))
        ends = list(self.closed([x.prefix, x.suffix]))
        return self._joined(ends[0], b"", self._joined(x, b"", ends[1]))


_WHOLE = "_id string, _text binary"
_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<int>"
_FRAGMENT = "_prefix binary, _cut boolean, _suffix binary, _said binary, _sizes array<long>, _pairs array<long>, _times array<long>, _good boolean"
_ALIGNERS: dict[str, Aligner] = {}


def _aligner(byte_json: str, piece_model: bytes) -> Aligner:
    """The aligner of this worker process; other vocabularies take its place."""
    key = hashlib.sha256(byte_json.encode() + piece_model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(byte_json, piece_model)
    return _ALIGNERS[key]


def _results(fragments: list[Fragment]) -> list[pa.Array]:
    """The columns of `_RESULT`; texts that a tokenizer does not reproduce have zeros."""
    good = [f if f.good and f.sizes[0] else None for f in fragments]
    sizes = np.array([(0, 0, 0, 0) if f is None else f.sizes for f in good], np.int64).reshape(-1, 4)
    digests = []
    for f in good:
        digest = hashlib.sha256()
        for i, part in enumerate(f.said if f else []):
            digest.update(b";" * (i > 0) + part)
        digests.append(digest.hexdigest() if f else "")
    offsets = pa.array(np.concatenate(([0], np.cumsum([0 if f is None else len(f.pairs) for f in good]))).astype(np.int32))
    pairs = np.concatenate([np.zeros(0, np.int64), *[f.pairs for f in good if f is not None]])
    times = np.concatenate([np.zeros(0, np.int64), *[f.times for f in good if f is not None]]).astype(np.int32)
    return [*[pa.array(sizes[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))]


def _fragment_table(fragments: list[Fragment], keys: dict[str, pa.Array]) -> pa.RecordBatch:
    made = {
        "_prefix": pa.array([f.prefix for f in fragments], pa.binary()), "_cut": pa.array([f.has_cut for f in fragments]), "_suffix": pa.array([f.suffix for f in fragments], pa.binary()),
        "_said": pa.array([b";".join(f.said) for f in fragments], pa.binary()), "_sizes": pa.array([f.sizes.tolist() for f in fragments], pa.list_(pa.int64())),
        "_pairs": pa.array([f.pairs.tolist() for f in fragments], pa.list_(pa.int64())), "_times": pa.array([f.times.tolist() for f in fragments], pa.list_(pa.int64())),
        "_good": pa.array([f.good for f in fragments]),
    }
    return pa.RecordBatch.from_arrays([*keys.values(), *made.values()], [*keys, *made])


def _fragment(row: dict) -> Fragment:
    return Fragment(
        row["_prefix"], row["_cut"], row["_suffix"], [row["_said"]] if row["_said"] else [], np.array(row["_sizes"], np.int64),
        np.array(row["_pairs"], np.int64), np.array(row["_times"], np.int64), row["_good"],
    )


def align(docs: DataFrame, vocabulary: tuple[str, bytes], span: int = RANGE) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, digest of the groups, and the linked pairs of each row with their occurrences, in blocks `_block`.

    Kept: the linked pairs are read twice.
    """
    byte_json, piece_model = vocabulary
    id_type = docs.schema["doc_id"].dataType.simpleString()
    long_text = F.coalesce(F.octet_length("text"), F.lit(0)) >= span

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_json, piece_model)
        number, held = TaskContext.get().partitionId() << 32, 0
        for block in columns.blocks(batches, "text", PASS):
            texts = [b" " + t.encode() if t else b"" for t in block.column("text").to_pylist()]
            size = sum(map(len, texts))
            held += size
            if held > BLOCK:
                number, held = number + 1, size
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([number] * len(texts), pa.int64()), *_results(list(aligner.closed(texts)))], names)

    names = ["doc_id", "_block", *[c.split(" ")[0] for c in _RESULT.split(", ")]]
    short = docs.where(~long_text).select("doc_id", "text").mapInArrow(whole, f"doc_id {id_type}, _block long, {_RESULT}")
    parts = [tables.keep(short, "aligned")]
    # Rows of long texts get a number of their own in a kept table, so that it stays when executors are lost.
    numbered = docs.where(long_text).select("doc_id", F.encode(F.concat(F.lit(" "), "text"), "UTF-8").alias("_raw")).withColumn("_row", F.monotonically_increasing_id())
    longs = tables.keep(numbered, "long-texts")
    most = longs.agg(F.max(F.octet_length("_raw"))).first()[0]
    if most is not None:
        parts.append(tables.keep(_long_texts(longs, most, id_type, vocabulary, span), "aligned-long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _long_texts(longs: DataFrame, most: int, id_type: str, vocabulary: tuple[str, bytes], span: int) -> DataFrame:
    """Results of texts of several ranges: a fragment a range, composed by a tree."""
    byte_json, piece_model = vocabulary
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("_raw") - 1) / span))).alias("_seq")
    ranges = longs.select("doc_id", "_row", number, "_raw").select("doc_id", "_row", "_seq", F.substring(F.col("_raw"), (F.col("_seq") * span + 1).cast("int"), F.lit(span)).alias("_raw"))
    keys = ("doc_id", "_row", "_seq")
    schema = f"doc_id {id_type}, _row long, _seq long, {_FRAGMENT}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_json, piece_model)
        for block in columns.blocks(batches, "_raw", PASS):
            yield _fragment_table([aligner.of_range(raw) for raw in block.column("_raw").to_pylist()], {k: block.column(k) for k in keys})

    def composed(group: pa.Table) -> pa.Table:
        aligner = _aligner(byte_json, piece_model)
        rows = group.sort_by("_seq").to_pylist()
        out = _fragment(rows[0])
        for row in rows[1:]:
            out = aligner.compose(out, _fragment(row))
        head = group.combine_chunks().slice(0, 1)
        return pa.Table.from_batches([_fragment_table([out], {"doc_id": head.column("doc_id").chunk(0), "_row": pa.array([rows[0]["_row"]]), "_seq": pa.array([rows[0]["_seq"] // FAN])})])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_json, piece_model)
        number, held = -1 - (TaskContext.get().partitionId() << 32), 0
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                done = aligner.finished(_fragment(row))
                held += sum(map(len, done.said))
                if held > BLOCK:
                    number, held = number - 1, 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([number]), *_results([done])], names)

    names = ["doc_id", "_block", *[c.split(" ")[0] for c in _RESULT.split(", ")]]
    dealt = ranges.repartition(tables.partitions(longs.sparkSession), "_row", "_seq")
    fragments = dealt.mapInArrow(first, schema)
    left = -(-most // span)
    while left > 1:
        fragments = fragments.groupBy("_row", F.floor(F.col("_seq") / FAN).alias("_node")).applyInArrow(composed, schema)
        left = -(-left // FAN)
    return fragments.mapInArrow(last, f"doc_id {id_type}, _block long, {_RESULT}")


def counted(aligned: DataFrame) -> DataFrame:
    """Add n_best and count_sum to aligned rows, from the counts of documents that hold a pair linked."""
    exploded = aligned.select("_block", F.explode("_pairs").alias("pair"))
    in_block = tables.keep(exploded.groupBy("_block", "pair").agg(F.count(F.lit(1)).alias("n")), "block-pairs")
    counts = in_block.groupBy("pair").agg(F.sum("n").alias("count"))
    best = counts.withColumn("a", F.shiftright("pair", 32))
    highest = best.groupBy("a").agg(F.max("count").alias("most"))
    rated = best.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = in_block.select("_block", "pair").join(rated, "pair")
    id_type = aligned.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def rate(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows, told = rows.combine_chunks(), told.sort_by("pair").combine_chunks()
        pairs, count, best_of = (told.column(c).to_numpy() for c in ("pair", "count", "best"))
        lists, often = rows.column("_pairs").combine_chunks(), rows.column("_times").combine_chunks()
        widths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(pairs, lists.flatten().to_numpy())
        times = often.flatten().to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(times * count[place] if len(place) else times)))
        ranked = np.concatenate(([0], np.cumsum(times * best_of[place] if len(place) else times)))
        ends = np.cumsum(widths)
        sums = [pa.array((t[ends] - t[ends - widths]).astype(np.int64)) for t in (ranked, total)]
        return pa.Table.from_arrays([*[rows.column(c) for c in kept[:5]], *sums, rows.column("groups_sha256")], [*kept[:5], "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(rate, schema)


def report(docs: DataFrame, vocabulary: tuple[str, bytes], span: int = RANGE) -> DataFrame:
    """Numbers of tokens, groups and links of every row, and how its links stand in the corpus."""
    return counted(align(docs, vocabulary, span))
