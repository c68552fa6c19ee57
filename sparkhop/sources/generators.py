"""Synthetic graphs for tests and benchmarks, of any size and made in parallel:
each task jumps to its place in the one sequence of draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: Graph500 quadrant probabilities .57 .19 .19 .05 in 16 bits, summed up. Fixed values.
RMAT_LIMITS = (37355, 49807, 62259)


#: Draws that one task makes, and draws that are made side by side in a task.
CHUNK, LANES = 1 << 20, 1 << 12


def _step(x: np.ndarray) -> np.ndarray:
    """Marsaglia's xorshift64 with shifts 13, 7, 17."""
    x = x ^ (x << np.uint64(13))
    x ^= x >> np.uint64(7)
    x ^= x << np.uint64(17)
    return x


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A 64 x 64 bit matrix, given by its columns, times each of some states."""
    out = np.zeros_like(x)
    for j in range(64):
        out ^= matrix[j] * (x >> np.uint64(j) & np.uint64(1))
    return out


def _jump(n: int) -> np.ndarray:
    """The matrix of ``n`` steps: a step is linear over bits, so its powers are
    found by squaring."""
    power = _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    out = np.uint64(1) << np.arange(64, dtype=np.uint64)
    while n:
        if n & 1:
            out = _apply(power, out)
        power, n = _apply(power, power), n >> 1
    return out


def _draws(seed: int, first: int, n: int) -> np.ndarray:
    """Draws ``first`` to ``first + n - 1`` of the sequence of a seed: each lane
    makes neighbouring draws and starts where the lane before it ends."""
    each = max(1, -(-n // LANES))
    state = _apply(_jump(first), np.array([seed & _MASK], np.uint64))
    ahead = _jump(each)
    while len(state) * each < n:  # twice as many lanes
        state = np.concatenate([state, _apply(ahead, state)])
        ahead = _apply(ahead, ahead)
    out = np.empty((len(state), each), np.uint64)
    for k in range(each):
        state = _step(state)
        out[:, k] = state
    return out.reshape(-1)[:n]


def _edges(spark: SparkSession, n: int, draws: int, edges: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], seed: int) -> DataFrame:
    """(source, target) of ``n`` edges, in their order over the partitions;
    ``edges`` makes them of their numbers and of ``draws`` draws for each."""
    chunk = max(1, CHUNK // max(draws, 1))
    parts = max(1, -(-n // chunk))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first = part * chunk
                size = min(chunk, n - first)
                if size > 0:
                    made = edges(np.arange(first, first + size), _draws(seed, first * draws, size * draws))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in made], names=["source", "target"])

    return spark.range(0, parts, 1, parts).mapInArrow(rows, "source bigint, target bigint")


def uniform(spark: SparkSession, nodes: int, degree: int, seed: int) -> DataFrame:
    """Each node has ``degree`` edges to uniform targets."""
    return _edges(spark, nodes * degree, 1, lambda at, x: (at // degree, x % np.uint64(max(nodes, 1))), seed)


def rmat(spark: SparkSession, scale: int, edge_factor: int, seed: int) -> DataFrame:
    """``edge_factor * 2**scale`` edges over ``2**scale`` nodes with skewed degrees."""
    if not 0 <= scale < 64:
        raise ValueError("scale must be below 64")

    def edges(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        quadrant = np.searchsorted(np.array(RMAT_LIMITS, np.uint64), x & np.uint64(0xFFFF), side="right").reshape(len(at), scale)
        place = 1 << np.arange(scale - 1, -1, -1, dtype=np.int64)
        return (quadrant >> 1) @ place, (quadrant & 1) @ place

    return _edges(spark, edge_factor << scale, scale, edges, seed)


def uniform_distributed(spark: SparkSession, nodes: int, degree: int, seed: int) -> DataFrame:
    """A uniform graph of any size, made on the executors from hashes."""
    edge = spark.range(nodes * degree)
    target = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(nodes))
    return edge.select(F.floor(F.col("id") / degree).cast("bigint").alias("source"), target.alias("target"))
