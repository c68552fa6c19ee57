"""Importance resampling of documents towards a target distribution.

Target and raw text each get a bag-of-n-grams generative model: lower-cased
tokens (runs of word characters, runs of other marks) and their bigrams, hashed
into ``BUCKETS`` buckets, with add-one smoothing.  A document's log importance
weight is the sum over its n-grams of log p_target - log p_raw; adding standard
Gumbel noise and taking the k largest samples k documents without replacement
in proportion to their weights.  The raw model counts all documents; the target
model counts at most ``TARGET_ROWS`` rows of the target.  Noise is a hash of the
key, so runs agree.  The k-th key is found by counting 16-bit digits, at most
65,536 groups a round, not by sorting.

Defined results: null and empty texts have weight 0; rows that tie with the k-th
key are all kept; an empty table gives an empty result; repeated rows are
sampled alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import checkpointed, smallest_hashes

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
#: Share of the rows that a sample has.
SHARE = 0.85
SEED = 17

_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 word, 2 other
_KIND[33:] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[95] = 1
_KIND[128:] = 1


class Tokens(words.Words):
    """Runs of word characters and runs of other marks."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = words._LOWER[data]
        kind = _KIND[data]
        new = np.ones(len(data) + 1, bool)
        if len(data):
            new[1:-1] = kind[1:] != kind[:-1]
            new[offs] = True
        edge = np.flatnonzero(new)
        start, end = edge[:-1], edge[1:]
        real = kind[start] > 0 if len(data) else np.zeros(0, bool)
        self.start, self.end = start[real], end[real]
        self.first = np.searchsorted(self.start, offs)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each unigram and bigram."""
    t = Tokens(data, offs)
    h = t.hashes()
    two, at = words.grams(h, t.doc, 2)
    b = np.concatenate([h, two]) >> np.uint64(64 - 16)
    return b.astype(np.int64), np.concatenate([t.doc, t.doc[at]])


def count(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Hashed n-gram counts of all texts; at most BUCKETS rows reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offs in words.slices(batch, text):
                total += np.bincount(buckets(data, offs)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(text).mapInArrow(rows, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def weigh(docs: DataFrame, target: np.ndarray, raw: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_grams, log_weight) of each row under the two models' counts."""
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for part, data, offs in words.slices(batch, text):
                b, row = buckets(data, offs)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, weights=ratio[b], minlength=n))], names=[key, "n_grams", "log_weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(rows, f"`{key}` {kind}, n_grams bigint, log_weight double")


def gumbel(key: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column within +-2**62; None if k < 1."""
    if k < 1:
        return None
    shifted = F.col(column) + F.lit(1 << 62)
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(shifted, shift).bitwiseAND(F.lit(65535))
        held = rows if shift == 48 else rows.where(F.shiftright(shifted, shift + 16) == F.lit(prefix))
        for d, n in sorted(((r[0], r[1]) for r in held.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if k <= n:
                prefix = prefix << 16 | d
                break
            k -= n
        else:
            return None
    return prefix - (1 << 62)


def sample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: n_grams, log_weight, gumbel_key and kept."""
    raw_counts = count(docs, text)
    target_counts = count(target, text)
    weight = weigh(docs, target_counts, raw_counts, key, text)
    keyed = weight.withColumn("gumbel_key", F.col("log_weight") + gumbel(key, seed))
    scale = float(1 << 20)
    keyed = checkpointed(keyed.withColumn("rank_key", F.round(F.greatest(F.least("gumbel_key", F.lit(1e12)), F.lit(-1e12)) * scale).cast("bigint")))
    limit = kth_largest(keyed, "rank_key", math.floor(share * keyed.count()))
    kept = F.lit(False) if limit is None else F.col("rank_key") >= F.lit(limit)
    return keyed.withColumn("kept", kept).drop("rank_key")


def labelled_target(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS, key: str = "doc_id") -> DataFrame:
    """Documents labelled of good quality and not toxic: ``rows`` of them at
    most, by a hash of the key."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(key).isNotNull()).select(key).distinct()
    return docs.join(F.broadcast(smallest_hashes(good, key, rows)), key, "left_semi")
