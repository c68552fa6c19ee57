"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte runs.  Every adjacent pair that the
rank file knows is a queue entry: the bucket of its merge rank holds the list
positions, a bitmap over ranks marks the buckets in use, and
find-first-set at each level gives the lowest rank.  Entries whose pair has
changed meanwhile are stale and are skipped when they come up.  Work is
O(n log n) however long a pre-token is; ties go to the leftmost pair, as in the
tiktoken library.  The bitmap has two levels of 256-bit words, for up to 65,536 ranks.

Texts are encoded whole: they are parted where a pre-token must end, each
distinct part of about a megabyte of texts is looked up once by its hash, and
parts that a worker does not remember go through the pattern and the queue.

Defined results: a null text counts as empty and gives no ids; every input row
gives one output row, repeated rows and null keys included; an empty table gives
none.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .memo import Memo, gathered

#: Pre-tokens whose ids a worker remembers at most.
PRE_TOKENS = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[:33] = True

_BIT = [1 << k for k in range(256)]


class ByteBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
        size = max(self.ranks.values()) + 1
        if size > 1 << 16:
            raise ValueError(f"{size} ranks; two levels of 256-bit words hold {1 << 16}")
        self.pieces = [b""] * size
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.byte_pair = [self.ranks.get(bytes(divmod(k, 256)), -1) for k in range(1 << 16)]
        self.piece_bounds = np.cumsum([0, *map(len, self.pieces)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        decimal = [b"%d," % i for i in range(size)]
        width = max(map(len, decimal))
        self.decimal = np.frombuffer(b"".join(x.ljust(width, b" ") for x in decimal), np.uint8).reshape(size, width)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.memo = Memo()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token.

        ``bucket`` holds the positions of each rank that is queued, as a heap;
        bit r & 255 of ``leaf[r >> 8]`` and bit r >> 8 of ``top`` mark it."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: merged away
        before = list(range(-1, n - 1))
        bucket: dict[int, list[int]] = {}
        leaf: dict[int, int] = {}
        top, i, byte_pair, bit = 0, 0, self.byte_pair, _BIT
        for a, b in zip(piece, piece[1:]):
            r = byte_pair[a << 8 | b]
            if r >= 0:
                if r in bucket:
                    bucket[r].append(i)
                else:
                    bucket[r] = [i]
                    hi = r >> 8
                    if hi in leaf:
                        leaf[hi] |= bit[r & 255]
                    else:
                        leaf[hi] = bit[r & 255]
                        top |= bit[hi]
            i += 1
        while top:
            low = top & -top
            hi = low.bit_length() - 1
            w = leaf[hi]
            lowest = w & -w
            rank = hi << 8 | lowest.bit_length() - 1
            held = bucket[rank]
            if len(held) > 1:
                i = heappop(held)
            else:
                i = held[0]
                del bucket[rank]
                if w == lowest:
                    del leaf[hi]
                    top ^= low
                else:
                    leaf[hi] = w ^ lowest
            mid = end[i]
            if not mid or mid >= n:
                continue  # stale: the part or its neighbour is gone
            to = end[mid]
            if get(piece[i:to]) != rank:
                continue  # stale: the pair has grown
            end[i] = to
            end[mid] = 0
            if to < n:
                before[to] = i
                r = get(piece[i : end[to]])
                if r is not None:
                    if r in bucket:
                        heappush(bucket[r], i)
                    else:
                        bucket[r] = [i]
                        hi = r >> 8
                        if hi in leaf:
                            leaf[hi] |= bit[r & 255]
                        else:
                            leaf[hi] = bit[r & 255]
                            top |= bit[hi]
            left = before[i]
            if left >= 0:
                r = get(piece[left:to])
                if r is not None:
                    if r in bucket:
                        heappush(bucket[r], left)
                    else:
                        bucket[r] = [left]
                        hi = r >> 8
                        if hi in leaf:
                            leaf[hi] |= bit[r & 255]
                        else:
                            leaf[hi] = bit[r & 255]
                            top |= bit[hi]
        out, i = [], 0
        while i < n:
            to = end[i]
            out.append(get(piece[i:to]))
            i = to
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text by its pre-tokens."""
        known, out = self.known, []
        if len(known) > PRE_TOKENS:
            known.clear()
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                ids = self.merge(part.encode())
                if len(part) <= 64:
                    known[part] = ids
            out += ids
        return out

    def encode_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and their number)."""
        start, end = parts(data, offs)
        ids, at = self.memo.ids(data, start, end, lambda new: [self.encode(x.decode("utf-8", "replace")) for x in new])
        return ids, at[np.append(np.searchsorted(start, offs[:-1]), len(start))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each id's begin, and their number)."""
        return gathered(self.piece_bytes, self.piece_bounds[ids], self.piece_bounds[ids + 1] - self.piece_bounds[ids])

    def decimal_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as decimal numbers, a comma after each, where each begins)."""
        rows = self.decimal[ids]
        held = rows != ord(" ")
        run = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(held.sum(1), out=run[1:])
        return rows[held], run


def parts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts of some texts that no pre-token crosses.

    A single blank between characters that are not white starts a pre-token, a
    single line feed there is one, and marks at the end of a word begin one after
    an ASCII letter.  Control characters count as white, to be on the safe side."""
    n = len(data)
    white = _CONTROL[data]
    if n > 1:
        a, b = data[:-1], data[1:]
        for at, size in (
            (np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0))), 2),
            (np.flatnonzero(((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))), 3),
        ):
            if size == 3 and len(at):
                third = data[np.minimum(at + 2, n - 1)]
                of_e2 = ((data[at + 1] == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((data[at + 1] == 0x81) & (third == 0x9F))
                at = at[np.where(data[at] == 0xE2, of_e2, third == 0x80)]
            for k in range(size):
                white[np.minimum(at + k, n - 1)] = True
    single = np.zeros(n, bool)
    if n > 2:
        single[1:-1] = ~white[:-2] & ~white[2:]
    cut = offs[(offs > 0) & (offs < n)]
    single[cut] = single[cut - 1] = False
    blank, feed = single & (data == 32), single & (data == 10)
    opens = np.zeros(n + 1, bool)
    opens[offs] = True
    opens[:-1] |= blank | feed
    opens[1:] |= feed
    # marks that end a part, after a letter
    last = opens[1:] & (_MARK[data] if n else opens[1:])
    if last.any():
        before = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(n)))[np.flatnonzero(last)]
        before = before[before >= 0]
        opens[before[_LETTER[data[before]]] + 1] = True
    opens[n] = False
    start = np.flatnonzero(opens)
    return start, np.append(start[1:], n) if n else start


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of this process for a rank file that every machine has."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded binary) of each row; null text: empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part, data, offs in words.slices(batch, "t"):
                ids, at = bpe.encode_all(data, offs)
                raw, byte = bpe.decode_all(ids)
                held, raw = pa.array(ids.astype(np.int32)), raw.tobytes()
                decoded = [raw[a:b] for a, b in zip(byte[at].tolist(), byte[at[1:]].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), held), pa.array(decoded, pa.binary())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(rows, f"`{key}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: the digests of
    what ``encode`` gives, taken where the ids are made."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for part, data, offs in words.slices(batch, "t"):
                ids, at = bpe.encode_all(data, offs)
                columns = [part.column(0), pa.array(np.diff(at))]
                for (held, run), comma in ((bpe.decimal_all(ids), 1), (bpe.decode_all(ids), 0)):
                    held, run = memoryview(held.tobytes()), run[at].tolist()
                    columns.append(pa.array([hashlib.sha256(held[a : max(a, b - comma)]).hexdigest() for a, b in zip(run, run[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(rows, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
