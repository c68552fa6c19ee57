"""A graph over an edge table, with a live overlay of changes.

The base is a DataFrame (source, target, weight, seq); ``seq`` is the input's
order.  Changes are a driver-side log of bounded size (see CompactionPolicy):
an insertion for each (source, target) at most, and tombstones that hide all
parallel base copies; larger sets of changes are merged as a table.  Base rows
keep duplicates and self-loops.

A base of at most ``ADJACENCY_EDGES`` edges, counted before, may be held as
adjacency arrays as well (``Graph.adjacency``), as a broadcast side would be.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..errors import InvalidEdge, MemoryLimitExceeded, PlanError
from ..functions.ids import MAX_ID, checked_id, weight_of

EDGE = "source bigint, target bigint, weight float, seq bigint"
#: Edges up to which a graph's arrays are gathered (24 bytes each on the way).
ADJACENCY_EDGES = 4_000_000
#: Bytes of an edge in a shard.
EDGE_BYTES = 16


@dataclass(frozen=True)
class EdgeData:
    weight: float | None = None
    label: str | None = None


@dataclass(frozen=True)
class CompactionPolicy:
    max_delta_entries: int = 100_000
    ratio: float = 0.01


@dataclass(frozen=True)
class BuildConfig:
    """Columns of the edge table; ``memory_limit`` bounds 16 bytes an edge, the
    least an adjacency of that size takes.  The base has ``shards`` partitions,
    or as many as ``shard_bytes`` makes of the counted edges, or else as many as
    Spark chooses."""

    source: str = "source"
    target: str = "target"
    weight: str | None = None
    memory_limit: int | None = None
    shards: int | None = None
    shard_bytes: int | None = None


class Delta:
    """Insertions and tombstones; an insertion lifts the tombstone of its edge,
    a deletion takes the insertion back and always leaves a tombstone.

    A compaction seals the log, builds from what was sealed, and then releases
    it: entries go that have not changed since.  Readers see all entries until
    then, and a compaction that fails releases nothing."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.inserts: dict[tuple[int, int], EdgeData] = {}
        self.tombstones: set[tuple[int, int]] = set()
        self._changed: set[tuple[int, int]] = set()  # since it was sealed

    def insert(self, source: int, target: int, data: EdgeData | None = None) -> None:
        if not (0 <= source <= MAX_ID and 0 <= target <= MAX_ID):
            raise InvalidEdge(source=source, target=target)
        with self._lock:
            self.tombstones.discard((source, target))
            self.inserts[source, target] = data or EdgeData()
            self._changed.add((source, target))

    def delete(self, source: int, target: int) -> None:
        with self._lock:
            self.inserts.pop((source, target), None)
            self.tombstones.add((source, target))
            self._changed.add((source, target))

    def seal(self) -> tuple[dict[tuple[int, int], EdgeData], set[tuple[int, int]]]:
        """The entries so far; later changes are told apart from them."""
        with self._lock:
            self._changed = set()
            return dict(self.inserts), set(self.tombstones)

    def release(self, inserts: dict[tuple[int, int], EdgeData], tombstones: set[tuple[int, int]]) -> None:
        """Drops sealed entries that have not changed since."""
        with self._lock:
            for edge in [e for e in inserts if e not in self._changed]:
                self.inserts.pop(edge, None)
            self.tombstones -= {e for e in tombstones if e not in self._changed}

    def is_deleted(self, source: int, target: int) -> bool:
        return (source, target) in self.tombstones

    def has_insertion(self, source: int, target: int) -> bool:
        return (source, target) in self.inserts

    def insertion_count(self, source: int | None = None) -> int:
        return sum(source in (None, s) for s, _ in self.inserts)

    def deletion_count(self, source: int | None = None) -> int:
        return sum(source in (None, s) for s, _ in self.tombstones)

    def neighbors(self, source: int) -> list[int]:
        return [t for s, t in self.inserts if s == source]

    def snapshot(self) -> tuple[dict[tuple[int, int], EdgeData], set[tuple[int, int]]]:
        with self._lock:
            return dict(self.inserts), set(self.tombstones)

    def drain(self) -> tuple[dict[tuple[int, int], EdgeData], set[tuple[int, int]]]:
        with self._lock:
            out = self.inserts, self.tombstones
            self.inserts, self.tombstones = {}, set()
            return out

    def clear(self) -> None:
        self.drain()

    def __len__(self) -> int:
        return len(self.inserts) + len(self.tombstones)

    def memory_usage(self) -> int:
        return 48 * len(self.inserts) + 16 * len(self.tombstones)


class Graph:
    """An immutable base and a live delta."""

    def __init__(self, base: DataFrame, node_count: int, edge_count: int, weighted: bool = False, delta: Delta | None = None):
        self.base, self.node_count, self.edge_count, self.weighted = base, node_count, edge_count, weighted
        self.delta = delta or Delta()
        self._arrays: tuple | None = None

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def is_dirty(self) -> bool:
        return len(self.delta) > 0

    def contains(self, node: int) -> bool:
        return 0 <= node < self.node_count

    def merged(self) -> DataFrame:
        """The base without hidden edges, then insertions that are no live base
        edge; columns source, target, weight, seq."""
        return self._with(*self.delta.snapshot())

    def _with(self, inserts: dict[tuple[int, int], EdgeData], tombstones: set[tuple[int, int]]) -> DataFrame:
        if not inserts and not tombstones:
            return self.base
        live = self.base
        if tombstones:
            gone = self.spark.createDataFrame(sorted(tombstones), "source bigint, target bigint")
            live = live.join(gone, ["source", "target"], "left_anti")
        if not inserts:
            return live.select("source", "target", "weight", "seq")
        rows = [(s, t, d.weight, self.edge_count + i) for i, ((s, t), d) in enumerate(inserts.items())]
        new = self.spark.createDataFrame(rows, "source bigint, target bigint, weight double, seq bigint")
        new = new.join(live.select("source", "target"), ["source", "target"], "left_anti")
        return live.select("source", "target", "weight", "seq").unionByName(new.select("source", "target", F.col("weight").cast("float").alias("weight"), "seq"))

    def largest_inserted(self) -> int:
        """The largest node that an insertion names, -1 without any."""
        return max((max(edge) for edge in self.delta.snapshot()[0]), default=-1)

    def neighbors(self, node: int, base_only: bool = False) -> DataFrame:
        """Targets of a node in order; repeated for parallel edges."""
        edges = self.base if base_only else self.merged()
        return edges.where(F.col("source") == node).orderBy("seq").select("target")

    def has_edge(self, source: int, target: int) -> bool:
        if self.delta.is_deleted(source, target):
            return False
        if self.delta.has_insertion(source, target):
            return True
        return not self.base.where((F.col("source") == source) & (F.col("target") == target)).isEmpty()

    def has_edges(self, asked: DataFrame) -> DataFrame:
        """(source, target, found) of each row of a table (source, target)."""
        held = self.merged().select("source", "target").distinct().withColumn("found", F.lit(True))
        return asked.join(held, ["source", "target"], "left").select("source", "target", F.coalesce("found", F.lit(False)).alias("found"))

    def out_degree(self, node: int) -> int:
        return self.merged().where(F.col("source") == node).count()

    def degrees(self, column: str = "source") -> DataFrame:
        """(node_id, degree) of every node, nodes without edges included."""
        counted = self.merged().groupBy(F.col(column).alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.spark.range(self.node_count).select(F.col("id").alias("node_id")).join(counted, "node_id", "left").na.fill(0, ["degree"])

    def memory_usage(self) -> int:
        """Bytes of an adjacency in row pointers and 32-bit indices."""
        return 4 * (self.node_count + 1) + 4 * self.edge_count * (2 if self.weighted else 1) + self.delta.memory_usage()

    def shard_of(self, nodes: DataFrame) -> DataFrame:
        """(source, shard) of each node of a table (node_id) that has edges: the
        partition of the base that holds them."""
        held = self.base.select("source", F.spark_partition_id().alias("shard")).distinct()
        return held.join(nodes.select(F.col("node_id").alias("source")), "source", "left_semi")

    def checksum(self) -> int:
        """An order-independent hash of the base's topology."""
        return self.base.agg(F.coalesce(F.bit_xor(F.xxhash64("source", "target", "seq")), F.lit(0))).first()[0]

    def statistics(self) -> DataFrame:
        row = (self.node_count, self.edge_count, self.base.rdd.getNumPartitions() if self.edge_count else 0, self.memory_usage(), len(self.delta))
        return self.spark.createDataFrame([row], "node_count bigint, edge_count bigint, shard_count bigint, memory_bytes bigint, delta_entries bigint")

    def should_compact(self, policy: CompactionPolicy) -> bool:
        n = len(self.delta)
        return n > 0 and (n >= policy.max_delta_entries or self.edge_count > 0 and n >= self.edge_count * policy.ratio)

    def compact(self) -> Graph:
        """A clean graph of the edges as they are now; their changes leave the
        delta, changes made meanwhile stay in it.  Weights of insertions are
        dropped where the base has none."""
        sealed = self.delta.seal()
        out = _finish(self._weighed(self._with(*sealed)), self.weighted)
        self.delta.release(*sealed)
        return out

    def absorb(self, changes: DataFrame) -> Graph:
        """A graph with a table of changes (op, source, target, weight) merged
        in, one at most for each edge: the way for more changes than a delta
        should hold.  The delta's entries so far are merged first."""
        sealed = self.delta.seal()
        held = self._with(*sealed)
        named = changes.select("op", F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), F.col("weight").cast("float").alias("weight"))
        bad = named.where(~(F.col("source").between(0, MAX_ID) & F.col("target").between(0, MAX_ID))).first()
        if bad is not None:
            raise InvalidEdge(source=bad.source, target=bad.target)
        live = held.join(named.where("op <> 'insert'").select("source", "target"), ["source", "target"], "left_anti")
        new = named.where("op = 'insert'").join(live.select("source", "target"), ["source", "target"], "left_anti")
        late = F.lit(1 << 62) + F.monotonically_increasing_id()  # after all edges of the base
        out = _finish(self._weighed(live.select("source", "target", "weight", "seq").unionByName(new.select("source", "target", "weight", late.alias("seq")))), self.weighted)
        self.delta.release(*sealed)
        return out

    def _weighed(self, edges: DataFrame) -> DataFrame:
        if not self.weighted:
            return edges.withColumn("weight", F.lit(None).cast("float"))
        return edges.withColumn("weight", F.coalesce("weight", F.lit(1.0).cast("float")))

    def adjacency(self, limit: int = ADJACENCY_EDGES) -> tuple | None:
        """The base's adjacency arrays, gathered once; None beyond ``limit``
        edges.  A larger limit is the caller's to choose."""
        if self._arrays is None and self.edge_count <= limit:
            from . import csr

            self._arrays = csr.arrays(self)
        return self._arrays

    def transpose(self) -> Graph:
        """The graph with all edges turned, weights dropped; a snapshot."""
        turned = self.merged().select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(None).cast("float").alias("weight"), "seq")
        turned = checkpointed(turned.repartition("source"))
        return Graph(turned, self.node_count if not self.is_dirty else _sizes(turned)[0], turned.count())


def _sizes(edges: DataFrame) -> tuple[int, int]:
    top, n = edges.agg(F.greatest(F.max("source"), F.max("target")), F.count(F.lit(1))).first()
    return (0 if top is None else top + 1), n


def _finish(edges: DataFrame, weighted: bool, shards: int | None = None) -> Graph:
    """The base is hash-partitioned by source once, so that traversal levels
    join without moving it again."""
    edges = edges.select("source", "target", "weight", "seq")
    base = checkpointed(edges.repartition(shards, "source") if shards else edges.repartition("source"))
    nodes, n = _sizes(base)
    return Graph(base, nodes, n, weighted)


def restored(base: DataFrame, weighted: bool) -> Graph:
    """A graph of a base that was written as a table, the order included."""
    return _finish(base, weighted)


def build_graph(edges: DataFrame, config: BuildConfig | None = None) -> tuple[Graph, DataFrame]:
    """(graph, one row of build statistics).  Rows with a null end are dropped,
    null weights are 1, ids outside 0 .. 2**32 - 1 are errors."""
    config = config or BuildConfig()
    for c in filter(None, (config.source, config.target, config.weight)):
        if c not in edges.columns:
            raise PlanError(reason=f"column '{c}' not found in the edge table; it has {edges.columns}")
    weight = weight_of(F.col(config.weight)) if config.weight else F.lit(None).cast("float")
    shaped = edges.select(checked_id(F.col(config.source)).alias("source"), checked_id(F.col(config.target)).alias("target"), weight.alias("weight"))
    shaped = shaped.dropna(subset=["source", "target"]).withColumn("seq", F.monotonically_increasing_id())
    shards = config.shards
    if config.memory_limit is not None or shards is None and config.shard_bytes is not None:
        need = EDGE_BYTES * shaped.count()
        if config.memory_limit is not None and need > config.memory_limit:
            raise MemoryLimitExceeded(limit=config.memory_limit, requested=need)
        if shards is None and config.shard_bytes is not None:
            shards = max(1, -(-need // config.shard_bytes))
    import time

    began = time.monotonic()
    graph = _finish(shaped, config.weight is not None, shards)
    took = int((time.monotonic() - began) * 1000)
    stats = edges.sparkSession.createDataFrame([(graph.node_count, graph.edge_count, graph.base.rdd.getNumPartitions() if graph.edge_count else 0, took)], "node_count bigint, edge_count bigint, shard_count bigint, build_time_ms bigint")
    return graph, stats


def graph_from_edges(spark: SparkSession, edges: list[tuple[int, int]] | list[tuple[int, int, float]]) -> Graph:
    """A graph of a short list; three-tuples carry weights."""
    if edges and len(edges[0]) == 3:
        return build_graph(spark.createDataFrame(edges, "source bigint, target bigint, weight double").coalesce(1), BuildConfig(weight="weight"))[0]
    return build_graph(spark.createDataFrame(edges, "source bigint, target bigint").coalesce(1))[0]
