"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``SEED``-word runs in each ``WINDOW``-word
window the one with the least hash, so equal windows have equal anchors.  The
windows of one anchor occurrence form its reach: the anchor extended to both
sides as far as it stays the least.  Reaches join on their anchor.  One whose
whole content starts in a smaller document is repeated as a whole.  Where
occurrences of an anchor differ, one document for each different reach is
extended window by window, each window by a 128-bit hash of its words, which
finds the repeated part exactly.  Runs of repeated windows are the maximal
repeats.

Documents are grouped by a hash of their key in blocks of about ``BLOCK_BYTES``
of text, and at most about ``BLOCK_ROWS`` documents.  What a block sends is
pre-aggregated (its smallest document for each different content), and replies go
to blocks, so a passage that a third of all documents share sends one row a
block, of about 30 bytes for ``BLOCK_BYTES`` of text; the task that compares such
an anchor sorts those rows, spilling where it must.  Nothing is dropped or capped.

Defined results: null, empty and short texts keep all their words; a repeat
within one document alone is kept; rows with equal keys are one document to each
other (neither is smaller); a row without a key neither gives nor loses words.
Keys that are no whole numbers are ordered as Spark orders them.  Columns of any
name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..durable import numbered
from . import words

WINDOW = 13
SEED = 5
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4000

_U = np.uint64
_STEP = 0xD1342543DE82EF95
_STEP_INV = pow(_STEP, -1, 1 << 64)


class Reaches:
    """Anchor occurrences of some texts and the windows that each has."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.w = w = words.Words(data, offs)
        h = w.hashes()
        n = len(h)
        self.window_a, at = words.grams(h, w.doc, WINDOW)
        self.window_at = at  # first word of each window
        self.window_b = words.grams(words.mix(h), w.doc, WINDOW, seed=9)[0]
        if not len(at):
            self.anchor = self.content = np.zeros(0, np.uint64)
            self.first = self.count = self.doc = np.zeros(0, np.int64)
            return
        g, seed_at = words.grams(h, w.doc, SEED)
        seeds = np.full(n, _U(2**64 - 1))
        seeds[seed_at] = g
        wide = WINDOW - SEED + 1
        least, where = seeds[: n - WINDOW + 1].copy(), np.zeros(n - WINDOW + 1, np.int64)
        for k in range(1, wide):  # leftmost least
            other = seeds[k : n - WINDOW + 1 + k]
            less = other < least
            least[less] = other[less]
            where[less] = k
        place = at + where[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        self.anchor = seeds[place[first]]
        self.first, self.count, self.doc = first, count, w.doc[at[first]]
        # content: all words of all its windows, and where the anchor lies in them
        run = np.zeros(n + 1, np.uint64)
        power = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_STEP))]))
        back = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_STEP_INV))]))
        np.cumsum(h * power[:n], out=run[1:])
        a, b = at[first], at[first] + count + WINDOW - 1
        body = (run[b] - run[a]) * back[a]
        self.content = words.mix(body ^ words.mix(count.astype(np.uint64) * _U(64) + (place[first] - a).astype(np.uint64)))

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Indexes of all windows of the chosen occurrences."""
        count = self.count[chosen]
        if not len(count):
            return np.zeros(0, np.int64)
        start = np.cumsum(count) - count
        return np.repeat(self.first[chosen] - start, count) + np.arange(count.sum())


def _least(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, least value of each equal run) for sorting by key, value."""
    order = np.lexsort((value, key))
    k = key[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return order, start, value[order][start]


def _parts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, bytes, offsets, keys) of a block's table."""
    for batch in table.to_batches():
        for part, data, offs in words.slices(batch):
            yield part, data, offs, part.column(part.schema.get_field_index("key")).to_numpy()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _send_reaches(table: pa.Table) -> pa.Table:
    """(anchor, content, block, key): the smallest key of each reach."""
    anchors, contents, keys = [], [], []
    block = table.column("block")[0].as_py()
    for _, data, offs, key in _parts(table):
        r = Reaches(data, offs)
        anchors.append(r.anchor), contents.append(r.content), keys.append(key[r.doc])
    anchor, content, key = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (anchors, contents, keys))
    both = words.mix(anchor) ^ content
    order, start, least = _least(both, key.astype(np.int64))
    at = order[start]
    return pa.table([_signed(anchor[at]), _signed(content[at]), pa.array(np.full(len(at), block)), pa.array(least)], names=["anchor", "content", "block", "key"])


def _wanted(replies: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (first, second, least) of the replies of one kind."""
    k = replies.column("kind").to_numpy()
    mine = k == kind
    a, b, c = (replies.column(n).to_numpy()[mine] for n in ("first", "second", "least"))
    a, b = a.view(np.uint64), b.view(np.uint64)
    order = np.lexsort((b, a))
    return a[order], b[order], c[order]


def _look_up(held: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index in ``held`` of each (a, b), or -1."""
    ha, hb, _ = held
    if not len(ha):
        return np.full(len(a), -1)
    key, both = words.mix(ha) ^ hb, words.mix(a) ^ b
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.minimum(np.searchsorted(key, both), len(key) - 1)
    return np.where(key[at] == both, order[at], -1)


REACH, EXTEND, PART = 0, 1, 2  # kinds of replies: repeated reach, reach to extend, repeated window


def _extended(r: Reaches, key: np.ndarray, extend: tuple) -> np.ndarray:
    """Windows of the occurrences that are extended: their reach was asked for,
    in the document that stands for it."""
    at = _look_up(extend, r.anchor, r.content)
    chosen = np.flatnonzero((at >= 0) & (extend[2][np.maximum(at, 0)] == key[r.doc]) if len(extend[2]) else np.zeros(len(at), bool))
    return r.windows(chosen)


def _send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
    """(first, second, block, key): the smallest key of each window of the
    reaches that are extended."""
    out_a, out_b, keys = [], [], []
    if replies.num_rows and table.num_rows:
        extend = _wanted(replies, EXTEND)
        for _, data, offs, key in _parts(table):
            if len(extend[0]):
                r = Reaches(data, offs)
                at = _extended(r, key, extend)
                out_a.append(r.window_a[at]), out_b.append(r.window_b[at]), keys.append(key[r.w.doc[r.window_at[at]]])
    if not out_a:
        return pa.table([pa.array([], pa.int64())] * 4, names=["first", "second", "block", "key"])
    a, b, key = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(keys)
    order, start, least = _least(words.mix(a) ^ b, key)
    at = order[start]
    block = table.column("block")[0].as_py()
    return pa.table([_signed(a[at]), _signed(b[at]), pa.array(np.full(len(at), block)), pa.array(least)], names=["first", "second", "block", "key"])


Finish = Callable[[pa.RecordBatch, words.Words, np.ndarray], pa.RecordBatch]


def _covered(table: pa.Table, replies: pa.Table) -> Iterator[tuple[pa.RecordBatch, words.Words, np.ndarray]]:
    """(part, words, which are covered by repeated windows) of a block."""
    none = pa.table([pa.array([], pa.int64())] * 4, names=["kind", "first", "second", "least"])
    replies = replies if replies.num_rows else none
    reach, extend, part_reply = (_wanted(replies, k) for k in (REACH, EXTEND, PART))
    # least keys inside the block, as they were sent
    sent_a, sent_c, sent_k, win_a, win_b, win_k = [], [], [], [], [], []
    for _, data, offs, key in _parts(table):
        r = Reaches(data, offs)
        sent_a.append(r.anchor), sent_c.append(r.content), sent_k.append(key[r.doc])
        at = _extended(r, key, extend)
        win_a.append(r.window_a[at]), win_b.append(r.window_b[at]), win_k.append(key[r.w.doc[r.window_at[at]]])

    def least(a: list, b: list, k: list) -> tuple[np.ndarray, np.ndarray]:
        both = words.mix(np.concatenate(a)) ^ np.concatenate(b) if a else np.zeros(0, np.uint64)
        order, start, low = _least(both, np.concatenate(k) if k else np.zeros(0, np.int64))
        return both[order][start], low

    def smaller(held: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, key: np.ndarray, reply: tuple) -> np.ndarray:
        """Whether the content starts in a smaller document, of any block."""
        both = words.mix(a) ^ b
        low = held[1][np.searchsorted(held[0], both)] if len(both) else np.zeros(0, np.int64)
        at = _look_up(reply, a, b)
        if len(reply[2]):
            low = np.where(at >= 0, np.minimum(low, reply[2][np.maximum(at, 0)]), low)
        return low < key

    block_reach, block_part = least(sent_a, sent_c, sent_k), least(win_a, win_b, win_k)
    for part, data, offs, key in _parts(table):
        r = Reaches(data, offs)
        hit = np.zeros(len(r.window_at), bool)
        if len(r.anchor):
            hit[r.windows(np.flatnonzero(smaller(block_reach, r.anchor, r.content, key[r.doc], reach)))] = True
            at = _extended(r, key, extend)
            if len(at):
                hit[at[smaller(block_part, r.window_a[at], r.window_b[at], key[r.w.doc[r.window_at[at]]], part_reply)]] = True
        mark = np.zeros(len(r.w.start) + WINDOW + 1, np.int32)
        np.add.at(mark, r.window_at[hit], 1)
        np.add.at(mark, r.window_at[hit] + WINDOW, -1)
        yield part, r.w, np.cumsum(mark)[: len(r.w.start)] > 0


def _dedup(docs: DataFrame, key: str, finish: Finish, schema: str) -> DataFrame:
    """``finish`` of each part of a block, its words, and which are repeated.
    docs: a key, ``text`` and further columns, none named ``block`` or (but for
    the key) ``key``; rows with a null key are left out."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    rows = docs.where(F.col(key).isNotNull()).withColumn("key", F.col(key).cast("bigint")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    # all three groupings below take these same rows, so one exchange of the texts serves them
    reaches = rows.groupBy("block").applyInArrow(_send_reaches, "anchor bigint, content bigint, block bigint, key bigint")
    same, anchor = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    reaches = reaches.withColumns({"least": F.min("key").over(same), "low": F.min("content").over(anchor), "high": F.max("content").over(anchor)})
    repeated, stands = F.col("key") > F.col("least"), F.col("low") != F.col("high")
    kind = F.when(repeated, F.lit(REACH)).when(stands, F.lit(EXTEND))
    replies = reaches.select("block", kind.alias("kind"), F.col("anchor").alias("first"), F.col("content").alias("second"), "least").where("kind is not null")
    windows = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_send_windows, "first bigint, second bigint, block bigint, key bigint")
    windows = windows.withColumn("least", F.min("key").over(Window.partitionBy("first", "second"))).where("key > least")
    every = replies.unionByName(windows.select("block", F.lit(PART).alias("kind"), "first", "second", "least"))

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        done = [finish(*x) for x in _covered(table, replies)] if table.num_rows else []
        return pa.Table.from_batches(done) if done else empty

    frame = docs.sparkSession.createDataFrame([], schema)
    empty = pa.Table.from_batches([], schema=frame.toArrow().schema)
    return rows.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(last, schema)


def _ranked(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(docs with the rank of their key, keys and ranks); a null key has none."""
    ranks = numbered(docs.where(F.col(key).isNotNull()).select(key).distinct(), [key], "rank")
    return docs.join(ranks, key, "left"), ranks


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""

    def finish(part: pa.RecordBatch, w: words.Words, gone: np.ndarray) -> pa.RecordBatch:
        n, removed, digest = np.diff(w.first), np.zeros(part.num_rows, np.int64), []
        raw = w.data.tobytes()
        start, end = w.start.tolist(), w.end.tolist()
        run = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(gone, out=run[1:])
        removed = np.diff(run[w.first])
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            keep = (np.flatnonzero(~gone[a:b]) + a).tolist() if removed[i] else range(a, b)
            digest.append(hashlib.sha256(b" ".join([raw[start[k] : end[k]] for k in keep])).hexdigest())
        keys = part.column(part.schema.get_field_index("key"))
        return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(removed), pa.array(digest, pa.string())], names=["key", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[key].dataType
    if not isinstance(kind, IntegralType):
        slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        ranked, ranks = _ranked(slim, "k")
        done = digests(ranked.drop("k"), "rank").join(ranks, "rank", "left")
        return done.select(F.col("k").alias(key), "n_words", "n_removed", "kept_sha256")
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ws = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    alone = slim.where("key is null").select("key", F.size(ws).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.sha2(F.array_join(ws, " "), 256).alias("kept_sha256"))
    done = _dedup(slim, "key", finish, "key bigint, n_words bigint, n_removed bigint, kept_sha256 string").unionByName(alone)
    return done.select(F.col("key").cast(kind).alias(key), "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns; repeated words are cut from the text together with
    the white space after them, and ``size``, if there, is counted again."""
    columns = docs.columns
    at = columns.index(text)
    size_at = columns.index(size) if size in columns else None
    inner = [f"c{i}" if i != at else "text" for i in range(len(columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, inner)))
    key_at = inner[columns.index(key)]
    if not isinstance(plain.schema[key_at].dataType, IntegralType):
        ranked, _ = _ranked(plain, key_at)
        done = remove(ranked.withColumnRenamed(inner[size_at], "n_chars") if size_at is not None else ranked, "rank", "text", "n_chars" if size_at is not None else None)
        done = done.withColumnRenamed("n_chars", inner[size_at]) if size_at is not None else done
        return done.select(*(F.col(n).alias(c) for n, c in zip(inner, columns)))
    schema = plain.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def finish(part: pa.RecordBatch, w: words.Words, gone: np.ndarray) -> pa.RecordBatch:
        columns = [part.column(part.schema.get_field_index(n)) for n in inner]
        texts, offs = columns[at].to_pylist(), 0
        cut = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.first[:-1], len(gone))) if len(w.first) > 1 else []
        for i, t in enumerate(texts):
            a, b = int(w.first[i]), int(w.first[i + 1])
            raw = t.encode() if t else b""
            if b > a and cut[i]:
                pieces, done = [], 0
                for k in (np.flatnonzero(gone[a:b]) + a).tolist():
                    stop = int(w.start[k + 1]) - offs if k + 1 < b else len(raw)
                    pieces.append(raw[done : max(done, int(w.start[k]) - offs)])
                    done = stop
                texts[i] = (b"".join(pieces) + raw[done:]).decode()
            offs += len(raw)
        columns[at] = pa.array(texts, columns[at].type)
        if size_at is not None:
            columns[size_at] = pa.array([None if t is None else len(t) for t in texts], columns[size_at].type)
        return pa.RecordBatch.from_arrays(columns, names=inner)

    alone = plain.where(F.col(key_at).isNull())
    if size_at is not None:
        alone = alone.withColumn(inner[size_at], F.char_length("text").cast(schema[size_at].dataType))
    done = _dedup(plain, key_at, finish, ddl).unionByName(alone)
    return done.select(*(F.col(n).alias(c) for n, c in zip(inner, columns)))
