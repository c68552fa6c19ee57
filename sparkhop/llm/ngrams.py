"""Log perplexity of texts under byte n-gram models of their languages.

For each language an interpolated modified Kneser-Ney model of ``ORDER`` bytes is
counted over all documents.  An n-gram is in the model if at least ``least_docs``
documents hold it: what only a few hold would be predicted from these few alone,
and their style would seem likely.  The top order has counts, the orders below it numbers of
different predecessors, down to two bytes, and then even shares.  The discounts
are estimated for each language and next-to-last byte.

The model grows with the input and is never gathered or broadcast.  Texts are
dealt to blocks of a bounded size.  A block sends its distinct n-grams with
their counts, sorted and packed, to shards by language and next-to-last byte; so
all n-grams that an n-gram's probability depends on, of each order, are in one
shard.  The sorted arrays of up to ``fan`` blocks are merged by one task, and so
on until a shard is one array; each group of ``fan`` blocks then gets its replies
from a copy of the shard's array.  Counts are merged before they are exchanged
again, so a frequent n-gram or language is no hot task.

Values are sent in thousandths of a nat (16 bits).  Languages are told apart by
24 bits of a hash.  Null and empty texts, and texts of fewer bytes than
``ORDER``, have no n-grams and a null value.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

ORDER = 5


@dataclass(frozen=True)
class Limits:
    """Documents that hold an n-gram of the model at least (below 256), bytes of
    a block, shards, blocks whose n-grams one task merges or answers, and bytes
    whose n-grams are held at a time.  Only the first changes results."""

    least_docs: int = 16
    block_bytes: int = 16 << 20
    shards: int = 64
    fan: int = 256
    piece: int = 1 << 20


TEXTS = "block bigint, texts binary"
COUNTS = "block bigint, shard int, grams binary, counts binary, docs binary"
REPLIES = "block bigint, grams binary, nats binary"
_U = np.uint64
_LOW = _U((1 << 8 * ORDER) - 1)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, compressed; most of their bytes are 0."""
    x = np.ascontiguousarray(x).reshape(-1)
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=_U(0)))


def _unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of ORDER bytes as a number, row) of each place in some texts."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = row[:n] == row[ORDER - 1 :]
    code = np.zeros(n, np.uint64)
    for k in range(ORDER):
        code <<= _U(8)
        code |= data[k : n + k]
    return code[whole], row[:n][whole]


def pieces(batch: pa.RecordBatch, piece: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, bool, np.ndarray, np.ndarray]]:
    """(part, whether more of its one text follows, bytes, offsets): texts of
    about ``piece`` bytes together; a longer one in several that overlap."""
    for part, data, offs in words.slices(batch, text, piece):
        if part.num_rows > 1 or len(data) <= 2 * piece:
            yield part, False, data, offs
            continue
        for at in range(0, len(data), piece):
            some = data[at : at + piece + ORDER - 1]
            yield part, at + piece < len(data), some, np.array([0, len(some)])


def languages(column: pa.Array) -> np.ndarray:
    """24 bits of a hash of each language, above the bits of an n-gram."""
    data, offs = words.buffers(column.fill_null("\0"))
    return (words.span_hashes(data, offs[:-1], offs[1:]) >> _U(40)) << _U(8 * ORDER)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, counts, documents up to ``most``) of several such lists, which
    are of different documents."""
    if len(found) == 1:
        return found[0]
    key, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in found)]), return_inverse=True)
    count = np.zeros((2, len(key)), np.int64)
    at = 0
    for u, c, d in found:  # each n-gram once a list
        place = of[at : at + len(u)]
        count[0, place] += c
        count[1, place] += d
        at += len(u)
    return key, count[0], np.minimum(count[1], most)


def counted(batches: Iterator[pa.RecordBatch], limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of texts (text, lang), their counts, and in how
    many documents, ``least_docs`` at most, each is."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    long: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part, goes_on, data, offs in pieces(batch, limits.piece):
            code, row = grams(data, offs)
            code |= languages(part.column(part.schema.get_field_index("lang")))[row]
            order = np.argsort(code, kind="stable")
            held = code[order]
            start = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(held))
            first = np.ones(len(held), np.int64)  # whether a place is a document's first of its n-gram
            first[1:] = (held[1:] != held[:-1]) | (row[order][1:] != row[order][:-1])
            docs = np.add.reduceat(first, start) if len(start) else np.zeros(0, np.int64)
            one = (held[start], end - start, np.minimum(docs, limits.least_docs))
            if goes_on or long:
                long.append(one)
                if not goes_on or len(long) > 32:
                    u, c, _ = merged(long, 1)
                    long = [(u, c, np.ones(len(u), np.int64))]
                if not goes_on:
                    found += long
                    long = []
            else:
                found.append(one)
            if len(found) > 16:
                found = [merged(found, limits.least_docs)]
    return merged(found, limits.least_docs)


class Model:
    """Probabilities from all counted n-grams of some languages and
    next-to-last bytes: sorted arrays of the n-grams of each order, their own
    shares, and the shares that their histories leave to the order below."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, docs: np.ndarray, least: int):
        kept = docs >= least
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.left: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        key, n = gram[kept], count[kept]
        discount = self._discounts(gram, count)
        for order in range(ORDER, 1, -1):
            if order < ORDER:
                key, n = np.unique(self._shorter(key, order), return_counts=True)
                discount = self._discounts(key, n)
            d = discount(key, n)
            history, of = np.unique(key >> _U(8), return_inverse=True)
            total = np.bincount(of, weights=n, minlength=len(history))
            self.own[order] = key, (n - d) / total[of]
            self.left[order] = history, np.bincount(of, weights=d, minlength=len(history)) / total

    @staticmethod
    def _shorter(key: np.ndarray, order: int) -> np.ndarray:
        """The last ``order`` bytes of n-grams one byte longer, and the language."""
        low = _U((1 << 8 * order) - 1)
        return (key >> _U(8 * order + 8) << _U(8 * order)) | (key & low)

    @staticmethod
    def _cell(key: np.ndarray, order: int) -> np.ndarray:
        return (key >> _U(8 * order) << _U(8)) | (key >> _U(8) & _U(255))

    def _discounts(self, key: np.ndarray, n: np.ndarray):
        """Discount of each n-gram by its count, estimated in its cell from how
        many n-grams have the counts 1 to 4."""
        order = ORDER - len(self.own)
        cell, of = np.unique(self._cell(key, order), return_inverse=True)
        seen = [np.maximum(1, np.bincount(of[n == i], minlength=len(cell))) for i in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        table = np.stack([np.clip(i - (i + 1) * y * seen[i] / seen[i - 1], 0.1, i - 0.1) for i in (1, 2, 3)], 1)

        def discount(key: np.ndarray, n: np.ndarray) -> np.ndarray:
            return table[np.searchsorted(cell, self._cell(key, order)), np.minimum(n, 3) - 1]

        return discount

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], key: np.ndarray, missing: float) -> np.ndarray:
        keys, values = held
        if not len(keys):
            return np.full(len(key), missing)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], missing)

    def p(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Probability of the last byte of each n-gram after the others."""
        if order == 1:
            return np.full(len(key), 1 / 256)
        shorter, of = np.unique(self._shorter(key, order - 1), return_inverse=True)
        return self._find(self.own[order], key, 0.0) + self._find(self.left[order], key >> _U(8), 1.0) * self.p(shorter, order - 1)[of]


def _texts(rows: DataFrame, limits: Limits) -> DataFrame:
    """(block, texts): rows in compressed blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

        for batch in batches:
            for part, data, _ in words.slices(batch, chunk=limits.piece):
                if held and size + len(data) > limits.block_bytes:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += len(data)
        if held:
            yield block()

    return rows.mapInArrow(send, TEXTS)


def _send(table: pa.Table, limits: Limits) -> pa.Table:
    """A block's n-grams, one row a shard."""
    gram, count, docs = counted(opened(table), limits)
    shard = (words.mix(Model._cell(gram, ORDER)) % _U(limits.shards)).astype(np.int64)
    rows = []
    for s in np.unique(shard).tolist():
        mine = shard == s
        rows.append((s, _pack_sorted(gram[mine]), _pack(count[mine]), _pack(docs[mine].astype(np.uint8))))
    return _rows(table.column("block")[0].as_py(), rows)


def _rows(block: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.Table:
    s, g, c, d = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array([block] * len(rows), pa.int64()), pa.array(s, pa.int32()), *(pa.array(x, pa.binary()) for x in (g, c, d))], names=["block", "shard", "grams", "counts", "docs"])


def _received(table: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged n-grams of some rows of COUNTS."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g, c, d in zip(*(table.column(x).to_pylist() for x in ("grams", "counts", "docs"))):
        gram = _unpack_sorted(g)
        found.append((gram, _unpack(c, np.int64), _unpack(d, np.uint8).astype(np.int64)))
        if len(found) > 32:
            found = [merged(found, most)]
    return merged(found, most)


def _merge(table: pa.Table, limits: Limits) -> pa.Table:
    gram, count, docs = _received(table, limits.least_docs)
    return _rows(table.column("group")[0].as_py(), [(table.column("shard")[0].as_py(), _pack_sorted(gram), _pack(count), _pack(docs.astype(np.uint8)))])


def _reply(asked: pa.Table, shard: pa.Table, limits: Limits) -> pa.Table:
    if not asked.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["block", "grams", "nats"])
    gram, count, docs = _received(shard, limits.least_docs)
    nats = np.round(-1000 * np.log(Model(gram, count, docs, limits.least_docs).p(gram))).astype(np.uint16)
    values = [_pack(nats[np.searchsorted(gram, _unpack_sorted(g))]) for g in asked.column("grams").to_pylist()]
    return pa.table([asked.column("block"), asked.column("grams"), pa.array(values, pa.binary())], names=["block", "grams", "nats"])


def means(batches: Iterator[pa.RecordBatch], gram: np.ndarray, nats: np.ndarray, limits: Limits) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(part, number of n-grams of each text, mean of their nats)."""
    for batch in batches:
        for part, held in itertools.groupby(pieces(batch, limits.piece), key=lambda x: x[0]):
            n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            lang = languages(part.column(part.schema.get_field_index("lang")))
            for _, _, data, offs in held:
                code, row = grams(data, offs)
                at = np.searchsorted(gram, code | lang[row])
                n += np.bincount(row, minlength=len(n))
                total += np.bincount(row, weights=nats[at], minlength=len(n))
            yield part, n, total / 1000 / np.maximum(n, 1)


def replied(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a block and their nats, from its replies."""
    found = [(_unpack_sorted(g), _unpack(v, np.uint16)) for g, v in zip(table.column("grams").to_pylist(), table.column("nats").to_pylist())]
    gram = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in found)])
    nats = np.concatenate([np.zeros(0, np.uint16), *(v for _, v in found)])
    order = np.argsort(gram)
    return gram[order], nats[order]


def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of a block."""
    for x in table.column("texts"):
        yield from pa.ipc.open_stream(x.as_buffer())


def exchanged(docs: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(texts in blocks, replies): the two sides of a cogroup by block, which
    ``opened``, ``replied`` and ``means`` read.  docs: a text, a lang, and further
    columns."""
    texts = _texts(docs, limits).repartition("block")  # one exchange serves both uses
    parts = groups = -(-_blocks(docs, limits) // limits.fan)
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    # merged by the same groups that are answered, so one exchange serves both
    sent = texts.groupBy("block").applyInArrow(lambda t: _send(t, limits), COUNTS).withColumn("group", group(groups))
    whole = sent.groupBy("shard", "group").applyInArrow(lambda t: _merge(t, limits), COUNTS)
    while parts > 1:
        parts = -(-parts // limits.fan)
        whole = whole.withColumn("group", group(parts)).groupBy("shard", "group").applyInArrow(lambda t: _merge(t, limits), COUNTS)
    copies = whole.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    replies = sent.groupBy("shard", "group").cogroup(copies.groupBy("shard", "group")).applyInArrow(lambda a, b: _reply(a, b, limits), REPLIES)
    return texts, replies


def _blocks(docs: DataFrame, limits: Limits) -> int:
    """About how many blocks there are; only the number of merges follows it."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // limits.block_bytes))
