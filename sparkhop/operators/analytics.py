"""Graph analytics on top of the traversal: scores, weighted paths, two-edge
patterns, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..errors import InvalidTraversal
from . import csr
from .graph import Graph
from .traverse import Backend, bfs, choose


def blast_radius(graph: Graph, start: int, max_depth: int, decay: float) -> DataFrame:
    """(node_id, depth, score): score is decay ** depth."""
    return bfs(graph, [start], max_depth).rows.select("node_id", "depth", F.pow(F.lit(float(decay)), F.col("depth")).alias("score"))


def shortest_paths(graph: Graph, start: int, backend: Backend = Backend.AUTO) -> DataFrame:
    """(node_id, distance, parent) of all nodes that the start reaches.

    Rounds of relaxation over the nodes whose distance has just dropped, until
    none does.  A path has fewer edges than there are nodes, so distances that
    still drop after as many rounds show a cycle of negative weight, an error.
    The rounds run over gathered arrays where the edges are few (counted first),
    else each is a join."""
    spark = graph.spark
    if choose(graph, backend) is Backend.ADJACENCY:
        return _shortest_in_memory(graph, start)
    edges = graph.merged().select("source", "target", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))
    rows = [(start, 0.0, None)] if graph.contains(start) else []
    best = spark.createDataFrame(rows, "node_id bigint, distance double, parent bigint")
    active = best
    for _ in range(graph.node_count + len(graph.delta) + 1):
        offers = edges.join(active.select(F.col("node_id").alias("source"), "distance"), "source")
        offers = offers.groupBy(F.col("target").alias("node_id")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("distance"), F.col("source").alias("parent"))).alias("o"))
        better = offers.join(best.select("node_id", F.col("distance").alias("known")), "node_id", "left").where("known is null or o.distance < known")
        active = checkpointed(better.select("node_id", "o.distance", "o.parent"))
        if active.isEmpty():
            return best
        best = checkpointed(best.join(active.select("node_id"), "node_id", "left_anti").unionByName(active))
    raise InvalidTraversal(reason="a cycle of negative weight has no shortest paths")


def _shortest_in_memory(graph: Graph, start: int) -> DataFrame:
    held = graph.base.select("source", "target", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"), "seq").toArrow()
    s, t, w, q = (held.column(c).to_numpy() for c in ("source", "target", "w", "seq"))
    order = np.lexsort((q, s))
    s, t, w = s[order], t[order], w[order]
    first = np.searchsorted(s, np.arange(graph.node_count + 1))
    distance, parent = np.full(graph.node_count, np.inf), np.full(graph.node_count, -1)
    active = np.array([start] if graph.contains(start) else [], np.int64)
    distance[active] = 0.0
    for _ in range(graph.node_count + 1):
        if not len(active):
            break
        size = first[active + 1] - first[active]
        at = np.repeat(first[active] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        offer = distance[s[at]] + w[at]
        better = offer < distance[t[at]]
        at, offer = at[better], offer[better]
        order = np.lexsort((s[at], offer, t[at]))  # the least offer of each, then the least parent
        at, offer = at[order], offer[order]
        active, of = np.unique(t[at], return_index=True)
        distance[active], parent[active] = offer[of], s[at[of]]
    else:
        raise InvalidTraversal(reason="a cycle of negative weight has no shortest paths")
    node = np.flatnonzero(np.isfinite(distance))
    rows = pa.table({"node_id": node, "distance": distance[node], "parent": pa.array(parent[node], mask=parent[node] < 0)})
    return graph.spark.createDataFrame(rows, "node_id bigint, distance double, parent bigint")


def two_hops(graph: Graph) -> DataFrame:
    """(a, b, c) of every two-edge pattern a -> b -> c; parallel edges match
    each on their own."""
    e = graph.merged()
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).join(e.select(F.col("source").alias("b"), F.col("target").alias("c")), "b").select("a", "b", "c")


def path_to(paths: DataFrame, node: int) -> list[int]:
    """The node list from the start to ``node``; one lookup a hop."""
    out: list[int] = []
    while node is not None:
        row = paths.where(F.col("node_id") == node).select("parent").first()
        if row is None:
            return []
        out.append(node)
        node = row[0]
    return out[::-1]


def weak_components(graph: Graph, backend: Backend = Backend.AUTO) -> DataFrame:
    """(node_id, component): the smallest id that is connected, edges taken
    both ways; nodes without edges stand alone.  Labels also jump to their
    label's label, so long chains need few rounds."""
    edges = graph.merged().select("source", "target")
    both = checkpointed(edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().repartition("source"))
    label = checkpointed(graph.spark.range(graph.node_count).select(F.col("id").alias("node_id"), F.col("id").alias("component")))
    while True:
        near = both.join(label.select(F.col("node_id").alias("target"), "component"), "target").groupBy(F.col("source").alias("node_id")).agg(F.min("component").alias("near"))
        step = label.join(near, "node_id", "left").select("node_id", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
        jump = label.select(F.col("node_id").alias("least"), F.col("component").alias("further"))
        step = checkpointed(step.join(jump, "least").select("node_id", F.col("component").alias("before"), F.least("least", "further").alias("component")))
        label = step.select("node_id", "component")
        if step.where("component <> before").isEmpty():
            return label


def khop_by_joins(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """Nodes at the ends of paths of 1 to ``hops`` edges, by a chain of joins:
    the plain relational form that the traversal replaces."""
    edges = edges.select("source", "target")
    step = edges.where(F.col("source") == start).select("target")
    out = step
    for _ in range(hops - 1):
        step = step.distinct().select(F.col("target").alias("source")).join(edges, "source").select("target")
        out = out.union(step)
    return out.distinct()
