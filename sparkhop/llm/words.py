"""Vectorised words of Arrow text columns: spans, 64-bit hashes, n-grams.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` (these bytes
never occur inside a multi-byte UTF-8 sequence).  Null texts count as empty.
Everything works on the UTF-8 buffer of an Arrow batch, a few megabytes at a
time, so memory does not follow the batch or partition size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_RADIX))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets into them) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offs, data = texts.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", chunk: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch by rows into parts of about ``chunk`` bytes of text; gives
    (part, bytes, offsets).  One longer text makes a part of its own."""
    at, n = 0, batch.num_rows
    column = batch.column(batch.schema.get_field_index(text))
    data, offs = buffers(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + chunk, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Spans:
    """64-bit hashes of byte spans, the same in every process."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.run = np.empty(n + 1, np.uint64)
        self.run[0] = 0
        np.cumsum(_BYTE[data] * _power(_RADIX, n), out=self.run[1:])
        self.scale = _power(_RADIX_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((self.run[end] - self.run[start]) * self.scale[start] + _U(0x51ED270B))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same in every process."""
    return Spans(data).of(start, end)


class Words:
    """Words of some texts: ``start``/``end`` byte offsets, ``doc`` row of each,
    ``first`` index of each row's first word (length rows + 1)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        start, end = inside.copy(), inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cut = offs[(offs > 0) & (offs < len(data))]
            start[cut] = inside[cut]
            end[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        return span_hashes(self.data, self.start, self.end)


def grams(word_hash: np.ndarray, doc: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that lie in one document, and the index
    of the first word of each."""
    total = len(word_hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    base = _U((0xD1342543DE82EF95 + 2 * seed) & (2**64 - 1) | 1)
    h = np.full(total - n + 1, _U(seed + 1))
    for k in range(n):
        h *= base
        h += word_hash[k : total - n + 1 + k]
    return mix(h[at] if len(at) < len(h) else h), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (length bytes + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
