"""Breadth-first search, one join a level, or over gathered adjacency arrays.

A base without pending changes whose edges are few (``ADJACENCY_EDGES``, counted
when it was built) is searched in memory, as a small side of a join would be
broadcast: both backends give the same rows and the same order of discovery.

A level of the distributed form joins the edges, which stay partitioned by source, with the frontier,
and drops targets that have been visited.  Spark broadcasts a small frontier at
run time by its measured size.  Each level is checkpointed, so plans stay small
and lost executors cost one level at most.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..errors import InvalidTraversal
from ..plans.spec import Direction, TraversalSpec, TraversalStats
from . import csr
from .graph import Graph

RESULT = "node_id bigint, depth int, path array<bigint>"
#: Levels after which the visited set is written as one table again.
FOLD = 8
#: Direction switches (Beamer et al.): to bottom-up when the frontier's edges
#: exceed 1 / ALPHA of the unvisited ones' and the frontier 1 / BETA of all nodes.
ALPHA, BETA = 14, 24


class Backend(Enum):
    AUTO = "auto"
    ADJACENCY = "adjacency"
    DISTRIBUTED = "distributed"


def choose(graph: Graph, backend: Backend) -> Backend:
    """What runs: arrays need a clean graph, and unless they were gathered
    before, one of few edges."""
    if backend is Backend.AUTO:
        return Backend.ADJACENCY if not graph.is_dirty and graph.adjacency() is not None else Backend.DISTRIBUTED
    if backend is Backend.ADJACENCY and (graph.is_dirty or graph.adjacency() is None):
        raise InvalidTraversal(reason="adjacency arrays need a graph without pending changes, and of few edges")
    return backend


@dataclass
class Reached:
    """Visited nodes with their depth; ``rank`` is the order of discovery where
    it was asked for."""

    rows: DataFrame
    edges: DataFrame
    directions: list[str] = field(default_factory=list)
    took_us: int = 0

    def result(self) -> DataFrame:
        out = self.rows.select("node_id", "depth", F.lit(None).cast("array<bigint>").alias("path"))
        return out.orderBy("rank") if "rank" in self.rows.columns else out

    def depth_of(self, node: int) -> int | None:
        found = self.rows.where(F.col("node_id") == node).select("depth").first()
        return None if found is None else found[0]

    def contains(self, node: int) -> bool:
        return self.depth_of(node) is not None

    def nodes_at_depth(self, depth: int) -> DataFrame:
        return self.rows.where(F.col("depth") == depth).select("node_id")

    def level_histogram(self) -> DataFrame:
        return self.rows.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))

    def stats(self, max_depth: int) -> TraversalStats:
        """Edges examined are all edges out of the nodes above ``max_depth``."""
        n, deepest = self.rows.agg(F.count(F.lit(1)), F.max("depth")).first()
        expanded = self.rows.where(F.col("depth") < max_depth).select(F.col("node_id").alias("source"))
        return TraversalStats(n, self.edges.join(expanded, "source").count(), deepest or 0, self.took_us)


def _starts(graph: Graph, starts: tuple[int, ...] | list[int]) -> list[int]:
    """Starts that exist, each once, in order.  A node that only an insertion
    names does not exist yet."""
    return [s for s in dict.fromkeys(starts) if graph.contains(s)]


def bfs(graph: Graph, starts: tuple[int, ...] | list[int], max_depth: int = 10, max_nodes: int | None = None, ordered: bool = False, backend: Backend = Backend.AUTO) -> Reached:
    """Nodes within ``max_depth`` hops of the starts; at most ``max_nodes``, in
    order of discovery (by parent, then by the edges' order)."""
    began = time.perf_counter()
    if choose(graph, backend) is Backend.ADJACENCY:
        out = _in_memory(graph, starts, max_depth, max_nodes, ordered)
    else:
        out = _distributed(graph, starts, max_depth, max_nodes, ordered)
    out.took_us = int((time.perf_counter() - began) * 1e6)
    return out


def _in_memory(graph: Graph, starts: tuple[int, ...] | list[int], max_depth: int, max_nodes: int | None, ordered: bool) -> Reached:
    nodes, depth = csr.search(*graph.adjacency(), list(starts), max_depth, max_nodes)
    columns, schema = {"node_id": nodes, "depth": depth}, "node_id bigint, depth int"
    if ordered or max_nodes is not None:
        columns["rank"], schema = np.arange(len(nodes)), schema + ", rank bigint"
    return Reached(graph.spark.createDataFrame(pa.table(columns), schema), graph.base)


def _distributed(graph: Graph, starts: tuple[int, ...] | list[int], max_depth: int, max_nodes: int | None, ordered: bool) -> Reached:
    spark, edges = graph.spark, graph.merged()
    first = _starts(graph, starts)
    ordered = ordered or max_nodes is not None
    if max_nodes is not None:
        first = first[:max_nodes]
    if ordered:
        schema, rows = "node_id bigint, depth int, rank bigint", [(s, 0, i) for i, s in enumerate(first)]
    else:
        schema, rows = "node_id bigint, depth int", [(s, 0) for s in first]
    frontier = spark.createDataFrame(rows, schema)
    levels, admitted = [frontier], len(first)
    for depth in range(1, max_depth + 1):
        if not admitted or max_nodes is not None and admitted >= max_nodes:
            break
        visited = _union(levels)
        seen = visited.select(F.col("node_id").alias("target"))
        step = edges.join(frontier.drop("depth").withColumnRenamed("node_id", "source"), "source")
        if ordered:
            found = step.groupBy("target").agg(F.min(F.struct("rank", "seq")).alias("by")).join(seen, "target", "left_anti")
            if max_nodes is not None:
                found = found.orderBy("by").limit(max_nodes - admitted)  # the cap is the operator's own
            frontier = _ranked(checkpointed(found), depth, admitted)
        else:
            found = step.select("target").distinct().join(seen, "target", "left_anti")
            frontier = found.select(F.col("target").alias("node_id"), F.lit(depth).alias("depth"))
        frontier = checkpointed(frontier)
        n = frontier.count()
        if not n:
            break
        admitted += n
        levels.append(frontier)
        if len(levels) > FOLD:
            levels = [checkpointed(_union(levels))]
    return Reached(_union(levels), edges)


def _ranked(found: DataFrame, depth: int, start: int) -> DataFrame:
    from ..durable import numbered

    flat = found.select("target", F.col("by.rank").alias("r"), F.col("by.seq").alias("s"))
    return numbered(flat, ["r", "s"], "rank", start).select(F.col("target").alias("node_id"), F.lit(depth).alias("depth"), "rank")


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def bfs_direction_optimized(graph: Graph, reverse: Graph, start: int, max_depth: int = 10) -> Reached:
    """Same nodes and depths as ``bfs``; a level whose frontier is large scans
    the edges into unvisited nodes instead of the frontier's own."""
    if reverse.node_count != graph.node_count or reverse.edge_count != graph.edge_count:
        raise InvalidTraversal(reason="the reverse graph does not match the forward graph")
    if reverse.is_dirty:
        raise InvalidTraversal(reason="the reverse graph has pending changes")
    if graph.is_dirty:
        return bfs(graph, [start], max_depth)
    spark = graph.spark
    first = _starts(graph, [start])
    frontier = spark.createDataFrame([(s, 0) for s in first], "node_id bigint, depth int")
    levels, directions, seen_edges = [frontier], [], 0
    for depth in range(1, max_depth + 1):
        if not first:
            break
        size = frontier.count()
        if not size:
            levels.pop()
            break
        ahead = graph.base.join(frontier.select(F.col("node_id").alias("source")), "source").count()
        seen = _union(levels).select("node_id")
        bottom_up = ahead * ALPHA > graph.edge_count - seen_edges - ahead and size * BETA >= graph.node_count
        seen_edges += ahead
        if bottom_up:
            # reverse edges start at the node that may be reached
            candidates = reverse.base.join(seen.withColumnRenamed("node_id", "source"), "source", "left_anti")
            found = candidates.join(frontier.select(F.col("node_id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id")).distinct()
        else:
            step = graph.base.join(frontier.select(F.col("node_id").alias("source")), "source", "left_semi")
            found = step.select(F.col("target").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        directions.append("bottom-up" if bottom_up else "top-down")
        frontier = checkpointed(found.withColumn("depth", F.lit(depth)))
        levels.append(frontier)
        if len(levels) > FOLD:
            levels = [checkpointed(_union(levels[:-1])), frontier]
    return Reached(_union(levels), graph.base, directions)


def traverse(graph: Graph, spec: TraversalSpec, reverse: Graph | None = None) -> Reached:
    """Runs a spec: incoming traversals run along the reverse graph's edges."""
    spec.check()
    if spec.direction is Direction.INCOMING:
        return bfs(reverse if reverse is not None else graph.transpose(), spec.start, spec.max_depth, spec.max_nodes)
    clean = reverse is not None and not reverse.is_dirty and not graph.is_dirty and reverse.edge_count == graph.edge_count
    if clean and len(spec.start) == 1 and spec.max_nodes is None:
        return bfs_direction_optimized(graph, reverse, spec.start[0], spec.max_depth)
    return bfs(graph, spec.start, spec.max_depth, spec.max_nodes)
