"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 machine.

A sequence of tokens is the encoding of its bytes exactly when each neighbouring pair is the encoding of
its own bytes. So a token's fit depends on its predecessor alone, and every prefix of a piece has one
last token. The transducer reads bytes and keeps only the token starts that a longer token may still
cover, each with the token that ends there. Such sets of starts are its states. They, and the moves
between them, are made when first met and kept by the worker process.

Cases: a null or empty text has no tokens; texts of any length are read once; repeated rows are encoded
like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from functools import cached_property
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attesta.llm import columns, tables

#: Kept moves, pairs and pieces of a worker process at most; beyond it they are made anew when next met.
KEPT_MOVES = 300_000
KEPT_PAIRS = 300_000
KEPT_PIECES = 200_000

_LOW = (1 << 32) - 1
_OTHER_SPACE = re.compile(r"[^\S \n]|\0")


def plainly_spaced(text: str) -> bool:
    """White space is single spaces and line feeds between other characters; no zero character is there."""
    ends = text[:1] in " \n" or text[-1:] in " \n"
    return not (ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._grow_trie()
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list] = {}
        self.reset()

    def _grow_trie(self) -> None:
        """Places in tokens as numbers, 0 at the beginning: the place after one more byte, the token that ends there (-1: none), and whether a longer one goes on."""
        self.after: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token, rank in self.ranks.items():
            place = 0
            for byte in token:
                self.goes_on[place] = True
                place = self.after.setdefault(place << 8 | byte, len(self.token_at))
                if place == len(self.token_at):
                    self.token_at.append(-1)
                    self.goes_on.append(False)
            self.token_at[place] = rank

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = [()]
        self.tail: list[int] = [-1]
        self.moves: dict[int, int] = {}
        self.begin = self._number((0,))

    def _number(self, state: tuple) -> int:
        """A state is its starts: each the place reached in a longer token, above 32 bits of the token that ends at the start, plus 1."""
        known = self.ids.get(state)
        if known is None:
            known = self.ids[state] = len(self.states)
            self.states.append(state)
            self.tail.append((state[-1] & _LOW) - 1)
        return known

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, and (-1, -1) for a token that merging never makes."""
        known = self.made.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if rank == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            self.made[token] = known
        return known

    def spine(self, token: int, side: int) -> list[tuple[bytes, float, float]]:
        """The pieces that stand at one edge of a token while it is made: bytes, time it begins and time it ends.

        Time is the rank of the merge; a piece ends when the next larger one swallows it.
        """
        known = self.edges.get((token, side))
        if known is None:
            known, end, piece = [], float("inf"), token
            while True:
                parts = self.halves(piece)
                begin = -1.0 if parts is None else float(piece)
                known.append((self.tokens[piece], begin, end))
                if parts is None:
                    break
                piece, end = parts[side], begin
            self.edges[token, side] = known
        return known

    def fits(self, last: int, token: int) -> bool:
        """Whether `token` may follow `last` (-1: the beginning) in an encoding.

        It may unless, at some time while both are made, the pieces that meet at their border would
        merge. At equal rank the merge further left comes first.
        """
        if self.halves(token) == (-1, -1):
            return False
        if last < 0:
            return True
        known = self.pairs.get(last << 32 | token)
        if known is None:
            known, ranks = True, self.ranks
            left, right = self.spine(last, 1), self.spine(token, 0)
            i, j = len(left) - 1, len(right) - 1
            while i >= 0 and j >= 0:
                a, _, a_end = left[i]
                b, _, b_end = right[j]
                rank = ranks.get(a + b)
                if rank is not None and rank < a_end and rank <= b_end:
                    known = False
                    break
                # the side that is swallowed first moves on
                if a_end <= b_end:
                    i -= 1
                else:
                    j -= 1
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[last << 32 | token] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte: every start that a longer token may still cover, with the token that ends there."""
        live, reached = [], -1
        for start in self.states[state]:
            place = self.after.get(start >> 32 << 8 | byte)
            if place is None:
                continue
            if reached < 0:
                token = self.token_at[place]
                if token >= 0 and self.fits((start & _LOW) - 1, token):
                    reached = token
            if self.goes_on[place]:
                live.append(place << 32 | start & _LOW)
        if reached < 0:
            raise ValueError(f"the vocabulary cannot spell byte {byte}")
        live.append(reached + 1)
        known = self.moves[state << 8 | byte] = self._number(tuple(live))
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token is that token.

        Each state names the token that ends at its place. Where a state has a single start, no later byte
        can change what came before, and it is emitted; that is after one token's length at most in
        any vocabulary whose tokens do not chain without end, and at the end of the piece at the latest.
        """
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(self.moves) > KEPT_MOVES:
            self.reset()
        out: list[int] = []
        state, moves, trail = self.begin, self.moves, []
        get, put = moves.get, trail.append
        for at in range(0, len(piece), 256):
            for byte in piece[at : at + 256]:
                state = get(state << 8 | byte) or self._move(state, byte)
                put(state)
            if len(trail) > 256:  # a long piece: emit up to the last place that no later byte can change
                settled = next((i for i in range(len(trail), 0, -1) if len(self.states[trail[i - 1]]) == 1), 0)
                out += self._emit(trail[:settled])
                del trail[:settled]
        return out + self._emit(trail)

    def _emit(self, trail: list[int]) -> list[int]:
        """Walk back from the last place over the tokens that end there."""
        found, at = [], len(trail)
        tail, sizes = self.tail, self.sizes
        while at:
            token = tail[trail[at - 1]]
            found.append(token)
            at -= sizes[token]
        found.reverse()
        return found

class Pieces(dict):
    """A stretch of text to its tokens as little-endian 32-bit numbers; pieces of a stretch are encoded one by one."""

    def __init__(self, transducer: Transducer, split):
        super().__init__()
        self.transducer = transducer
        self.split = split
        self.old: dict[str, bytes] = {}  # the pieces kept before the last change; those met again move over

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None and len(parts := self.split(piece)) > 1:
            out = b"".join([self[p] for p in parts])
        elif out is None:
            ids = self.transducer.encode_piece(piece.encode("utf-8"))
            out = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def _utf8_leads() -> dict[int, tuple[int, int, int]]:
    """Lead bytes to what must follow: the number of further bytes and the range of the next one."""
    leads = {b: (0, 0, 0) for b in range(0x80)}
    leads |= {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    leads |= {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)}
    leads |= {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}
    return leads


class Utf8Machine:
    """Bytes in, whole characters out; unfinished ones wait for the next bytes, wrong ones become U+FFFD."""

    LEADS = _utf8_leads()

    def __init__(self) -> None:
        self.held = b""
        self.need = (0, 0, 0)

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        held, (left, low, high) = self.held, self.need
        for byte in data:
            if left:
                if low <= byte <= high:
                    held += bytes((byte,))
                    left, low, high = left - 1, 0x80, 0xBF
                    if not left:
                        out.append(held.decode("utf-8"))
                        held = b""
                    continue
                out.append("�")
                held = b""
            left, low, high = self.LEADS.get(byte, (-1, 0, 0))
            if left < 0:
                out.append("�")
                left = 0
            elif left:
                held = bytes((byte,))
            else:
                out.append(chr(byte))
        self.held, self.need = held, (left, low, high)
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.held else ""
        self.held, self.need = b"", (0, 0, 0)
        return rest


class StreamDecoder:
    """Tokens in, text out, token by token; what a token adds in each state of the UTF-8 machine is kept."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.kept: dict[tuple[bytes, int], tuple[str, bytes, tuple[int, int, int]]] = {}
        self.plain: dict[int, str] = {}
        for token, data in tokens.items():
            machine = Utf8Machine()
            text = machine.feed(data)
            if not machine.held and "�" not in text:
                self.plain[token] = text

    def decode(self, ids: Sequence[int]) -> str:
        plain = self.plain
        try:
            return "".join(map(plain.__getitem__, ids))
        except KeyError:  # some token ends inside a character
            pass
        out: list[str] = []
        held, need = b"", (0, 0, 0)
        for token in ids:
            if not held:
                text = plain.get(token)
                if text is not None:
                    out.append(text)
                    continue
            move = self.kept.get((held, token))
            if move is None:
                machine = Utf8Machine()
                machine.held, machine.need = held, need
                text = machine.feed(self.tokens[token])
                move = self.kept[held, token] = (text, machine.held, machine.need)
            text, held, need = move
            out.append(text)
        if held:
            out.append("�")
        return "".join(out)


class Codec:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.split = regex.compile(pattern).findall
        self.stretches = "\\s" in pattern and " ?" in pattern  # a lone space or line feed then opens a piece

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(Transducer(self.ranks), self.split)

    @cached_property
    def decoder(self) -> StreamDecoder:
        return StreamDecoder({rank: token for token, rank in self.ranks.items()})

    def encode(self, text: str) -> bytes:
        pieces = self.pieces
        if not self.stretches or not plainly_spaced(text):
            return b"".join([pieces[p] for p in self.split(text)])
        stretches = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return b"".join([pieces[p] for p in stretches if p])

    def decode(self, ids: bytes) -> str:
        return self.decoder.decode(memoryview(ids).cast("I") if sys.byteorder == "little" else [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)])


def codec(content: bytes, pattern: str) -> Codec:
    """The worker process's codec for a vocabulary; it outlives tasks, so its states and pieces are made once."""
    kept = sys.__dict__.setdefault("_kept_codecs", {})
    key = (hash(content), pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Codec(content, pattern)
    return kept[key]


def vocabulary(spark: SparkSession, path: str):
    """The rank file, read by the driver and sent to each executor once; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of `docs` and the token ids of `text` as little-endian unsigned 32-bit numbers."""
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for block in columns.blocks(batches, "text", 4 << 20):
            out = pa.array([own.encode(t) if t else b"" for t in block.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*block.columns, out], [*names, ids])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(encoded: DataFrame, ranks, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the text that the ids stand for."""
    names = encoded.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for block in columns.blocks(batches, ids, 4 << 20):
            out = pa.array([own.decode(i) if i else "" for i in block.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns, out], [*names, text])

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, ranks, pattern: str, keep: list[str]) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again; kept columns of these names are replaced."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = docs.select(*[c for c in keep if c not in made])
    packed = tables.pack(docs.select(*dict.fromkeys([*kept.columns, "text"])), ["text"])
    carried = [c for c in packed.columns if c == "_row" or c in kept.columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for block in columns.blocks(batches, "text", 4 << 20):
            ids = [own.encode(t) if t else b"" for t in block.column("text").to_pylist()]
            again = [hashlib.sha256(own.decode(i).encode("utf-8")).hexdigest() for i in ids]
            out = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(again, pa.string())]
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in carried], *out], [*carried, *made])

    added = [T.StructField(n, t) for n, t in zip(made, (T.LongType(), T.StringType(), T.StringType()))]
    done = packed.mapInArrow(each, T.StructType([*packed.select(*carried).schema.fields, *added]))
    return done.select(*tables.unpack(done, kept), *made)
