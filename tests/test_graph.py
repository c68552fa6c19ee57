import random

import numpy as np
import pytest

from sparkhop.errors import InvalidEdge, InvalidTraversal, MemoryLimitExceeded, NotImplementedYet, PlanError
from sparkhop.operators import analytics, csr, stored
from sparkhop.operators import graph as graph_module
from sparkhop.operators.catalog import GraphCatalog
from sparkhop.operators.graph import BuildConfig, CompactionPolicy, EdgeData, build_graph, graph_from_edges
from sparkhop.operators.traverse import Backend, bfs, bfs_direction_optimized, choose, traverse
from sparkhop.plans.spec import Algorithm, Direction, TraversalSpec

TREE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 4)]


def depths(reached):
    return {r[0]: r[1] for r in reached.rows.select("node_id", "depth").collect()}


def edges(df):
    return sorted((r[0], r[1]) for r in df.select("source", "target").collect())


def fifo(pairs, starts, max_depth, cap=None):
    """Plain queue search over an edge list, for comparison."""
    out, todo = [], []
    n = max([max(p) for p in pairs], default=-1) + 1
    for s in dict.fromkeys(starts):
        if 0 <= s < n and (cap is None or len(out) < cap):
            out.append((s, 0))
            todo.append((s, 0))
    seen = {s for s, _ in out}
    while todo:
        node, d = todo.pop(0)
        if d == max_depth:
            continue
        for s, t in pairs:
            if s == node and t not in seen:
                if cap is not None and len(out) >= cap:
                    return out
                seen.add(t)
                out.append((t, d + 1))
                todo.append((t, d + 1))
    return out


def test_depths_limits_and_missing_starts(spark):
    g = graph_from_edges(spark, TREE)
    assert (g.node_count, g.edge_count) == (5, 5)
    assert depths(bfs(g, [0])) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    assert depths(bfs(g, [0], 1)) == {0: 0, 1: 1, 2: 1}
    assert depths(bfs(g, [0], 0)) == {0: 0}
    assert depths(bfs(g, [999])) == {}
    assert depths(bfs(g, [0, 0, 999])) == depths(bfs(g, [0]))
    assert len(depths(bfs(g, [0], 10, max_nodes=2))) == 2
    assert depths(bfs(g, [0], 10, max_nodes=0)) == {}
    found = bfs(g, [0])
    assert found.depth_of(4) == 2 and found.contains(3) and not found.contains(9)
    assert {r[0] for r in found.nodes_at_depth(1).collect()} == {1, 2}
    stats = found.stats(10)
    assert (stats.nodes_visited, stats.edges_examined, stats.max_depth_reached) == (5, 5, 2)
    assert found.result().schema.simpleString() == "struct<node_id:bigint,depth:int,path:array<bigint>>"


def test_multi_source_and_phantom(spark):
    g = graph_from_edges(spark, [(0, 2), (1, 2), (2, 3)])
    assert depths(bfs(g, [0, 1])) == {0: 0, 1: 0, 2: 1, 3: 2}
    assert depths(bfs(graph_from_edges(spark, [(0, 1), (3, 4)]), [2])) == {2: 0}


def test_empty_graph(spark):
    g = graph_from_edges(spark, [])
    assert (g.node_count, g.edge_count) == (0, 0)
    assert depths(bfs(g, [0])) == {}
    assert edges(g.transpose().merged()) == [] and g.statistics().first()[1] == 0


@pytest.mark.parametrize("seed", range(3))
def test_order_of_discovery_matches_a_queue(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(25), r.randrange(25)) for _ in range(60)]
    g = graph_from_edges(spark, pairs)
    for cap in (None, 7):
        got = [(x[0], x[1]) for x in bfs(g, [3, 1], 4, cap, ordered=True).result().collect()]
        assert got == fifo(pairs, [3, 1], 4, cap)
        nodes, depth = csr.search(*csr.arrays(g), [3, 1], 4, cap)
        assert list(zip(nodes.tolist(), depth.tolist())) == fifo(pairs, [3, 1], 4, cap)


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(12)], [(0, i) for i in range(1, 64)], [(0, 1), (0, 2), (1, 3), (2, 3)], [(i % 40, (i * i * 7 + 3) % 40) for i in range(300)]])
def test_direction_optimized_equals_plain(spark, pairs):
    g = graph_from_edges(spark, pairs)
    assert depths(bfs_direction_optimized(g, g.transpose(), 0, 20)) == depths(bfs(g, [0], 20))


def test_direction_optimized_refuses_and_falls_back(spark):
    g = graph_from_edges(spark, TREE)
    with pytest.raises(InvalidTraversal, match="TRV-E002"):
        bfs_direction_optimized(g, graph_from_edges(spark, [(1, 0)]), 0)
    back = g.transpose()
    back.delta.insert(4, 0)
    with pytest.raises(InvalidTraversal):
        bfs_direction_optimized(g, back, 0)
    clean = g.transpose()
    g.delta.insert(4, 5)
    assert depths(bfs_direction_optimized(g, clean, 0))[5] == 3


def test_bottom_up_is_chosen_for_wide_levels(spark):
    pairs = [(0, i) for i in range(1, 50)] + [(i, j) for i in range(1, 50) for j in (50, 51)]
    g = graph_from_edges(spark, pairs)
    found = bfs_direction_optimized(g, g.transpose(), 0, 5)
    assert "bottom-up" in found.directions and depths(found) == depths(bfs(g, [0], 5))


def test_delta(spark):
    g = graph_from_edges(spark, TREE)
    g.delta.insert(4, 5)
    g.delta.delete(0, 2)
    assert depths(bfs(g, [0])) == {0: 0, 1: 1, 3: 2, 4: 2, 5: 3}
    assert depths(bfs(g, [5])) == {}  # known only to the delta
    assert g.has_edge(4, 5) and not g.has_edge(0, 2) and g.has_edge(0, 1) and not g.has_edge(3, 0)
    assert g.out_degree(0) == 1 and g.edge_count == 5
    g.delta.insert(0, 2)  # lifts the tombstone
    assert not g.delta.is_deleted(0, 2) and g.out_degree(0) == 2
    g.delta.delete(0, 2)
    assert not g.delta.has_insertion(0, 2) and (g.delta.insertion_count(4), g.delta.deletion_count(0)) == (1, 1)


def test_delta_duplicates_and_parallel_edges(spark):
    g = graph_from_edges(spark, [(0, 1), (0, 2)])
    g.delta.insert(0, 2)
    g.delta.insert(0, 3)
    assert [r[0] for r in g.neighbors(0).collect()] == [1, 2, 3]
    assert [r[0] for r in g.neighbors(0, base_only=True).collect()] == [1, 2]
    p = graph_from_edges(spark, [(0, 1), (0, 1), (1, 1)])
    assert p.edge_count == 3 and p.out_degree(0) == 2
    p.delta.delete(0, 1)
    assert p.out_degree(0) == 0 and p.out_degree(1) == 1


def test_compaction(spark):
    g = graph_from_edges(spark, [(0, 1), (1, 2), (2, 3)])
    g.delta.insert(3, 4)
    g.delta.delete(1, 2)
    c = g.compact()
    assert c.edge_count == 3 and edges(c.base) == [(0, 1), (2, 3), (3, 4)] and not c.is_dirty and len(g.delta) == 0
    w = graph_from_edges(spark, [(0, 1, 2.5), (1, 2, 0.5)])
    w.delta.insert(2, 3, EdgeData(9.0))
    w.delta.insert(0, 1, EdgeData(7.0))  # the base's weight stays
    got = {(r.source, r.target): r.weight for r in w.compact().base.collect()}
    assert got == {(0, 1): 2.5, (1, 2): 0.5, (2, 3): 9.0}
    u = graph_from_edges(spark, [(0, 1)])
    u.delta.insert(1, 2, EdgeData(3.0))
    assert u.compact().base.where("weight is not null").isEmpty()


def test_compaction_policy(spark):
    g = graph_from_edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    policy = CompactionPolicy(3, 0.5)
    assert not g.should_compact(policy)
    g.delta.insert(9, 9)
    assert not g.should_compact(policy)
    g.delta.insert(8, 8)
    assert g.should_compact(policy)


def test_transpose_is_a_snapshot(spark):
    g = graph_from_edges(spark, [(0, 1, 2.0), (0, 2, 3.0), (1, 2, 1.0)])
    t = g.transpose()
    g.delta.insert(2, 0)
    assert edges(t.merged()) == [(1, 0), (2, 0), (2, 1)] and t.base.where("weight is not null").isEmpty()
    assert depths(bfs(graph_from_edges(spark, [(0, 1), (1, 2), (2, 3)]).transpose(), [3]))[0] == 3


def test_specs(spark):
    g = graph_from_edges(spark, TREE)
    assert TraversalSpec().max_depth == 10 and "algorithm=Bfs" in TraversalSpec((0,)).describe()
    for bad in (TraversalSpec((0,), algorithm=Algorithm.DFS), TraversalSpec((0,), algorithm=Algorithm.DIJKSTRA), TraversalSpec((0,), direction=Direction.BOTH)):
        with pytest.raises(NotImplementedYet):
            traverse(g, bad)
    assert depths(traverse(g, TraversalSpec((4,), direction=Direction.INCOMING))) == {4: 0, 1: 1, 2: 1, 0: 2}
    assert depths(traverse(g, TraversalSpec((0,)), g.transpose())) == depths(bfs(g, [0]))


def test_build_checks(spark):
    rows = spark.createDataFrame([(0, 1, None), (None, 2, 1.0), (1, 2, 0.5)], "a int, b bigint, w double")
    g, stats = build_graph(rows, BuildConfig("a", "b", "w"))
    assert stats.columns == ["node_count", "edge_count", "shard_count", "build_time_ms"] and stats.first()[:2] == (3, 2)
    assert sorted(r[0] for r in g.base.select("weight").collect()) == [0.5, 1.0]
    with pytest.raises(PlanError, match="not found"):
        build_graph(rows, BuildConfig("nope", "b"))
    with pytest.raises(MemoryLimitExceeded):
        build_graph(rows, BuildConfig("a", "b", memory_limit=16))
    for bad in ((0, 1 << 32), (-1, 0)):
        with pytest.raises(Exception, match="CSR-E002"):
            graph_from_edges(spark, [bad])
    with pytest.raises(InvalidEdge):
        g.delta.insert(0, 1 << 32)


def test_measures(spark):
    g = graph_from_edges(spark, [(0, 1), (0, 2), (3, 2)])
    assert {r[0]: r[1] for r in g.degrees().collect()} == {0: 2, 1: 0, 2: 0, 3: 1}
    assert g.memory_usage() == 4 * 5 + 4 * 3
    assert g.checksum() == graph_from_edges(spark, [(0, 1), (0, 2), (3, 2)]).checksum() != graph_from_edges(spark, [(0, 1), (0, 2)]).checksum()
    assert g.contains(3) and not g.contains(4) and not g.contains(-1)


def test_analytics(spark):
    g = graph_from_edges(spark, [(1, 2, 1.0), (1, 3, 4.0), (2, 3, 2.0), (3, 4, 1.0)])
    paths = analytics.shortest_paths(g, 1)
    assert {r.node_id: r.distance for r in paths.collect()}[4] == 4.0 and analytics.path_to(paths, 4) == [1, 2, 3, 4]
    assert analytics.path_to(paths, 0) == []
    blast = graph_from_edges(spark, [(1, 2), (1, 3), (2, 4), (2, 5), (3, 5)])
    assert {r.node_id: r.score for r in analytics.blast_radius(blast, 1, 2, 0.5).collect()} == {1: 1.0, 2: 0.5, 3: 0.5, 4: 0.25, 5: 0.25}
    parts = graph_from_edges(spark, [(0, 1), (2, 1), (4, 5), (6, 6)] + [(i, i + 1) for i in range(10, 30)])
    got = {r[0]: r[1] for r in analytics.weak_components(parts).collect()}
    assert got[2] == 0 and got[5] == 4 and got[3] == 3 and got[30] == 10
    pairs = spark.createDataFrame(TREE, "source bigint, target bigint")
    assert {r[0] for r in analytics.khop_by_joins(pairs, 0, 2).collect()} == {1, 2, 3, 4}


def test_stored_graphs(spark, tmp_path, monkeypatch):
    g = graph_from_edges(spark, [(s + 3, t + 3) for s, t in TREE] + [(0, 3), (0, 4)])
    g.delta.insert(4, 40)
    g.delta.delete(0, 4)
    monkeypatch.setattr(stored, "ASKED", 2)  # a frontier in several reads
    held = stored.write(g, f"file:{tmp_path}/g")
    assert held["size"] == 41 and held["node_count"] == g.node_count
    for reverse in (False, True):
        turned = g.transpose() if reverse else g
        for start in (0, 3, 4, 7):
            for cap in (None, 0, 3):
                want = [tuple(r) for r in bfs(turned, [start], 4, cap, ordered=True).rows.orderBy("rank").select("node_id", "depth").collect()]
                got = [(n, d) for nodes, d in stored.search(held["path"], start, 4, cap, held["node_count"], held["size"], reverse) for n in nodes.tolist()]
                assert got == want, (reverse, start, cap)
    (next((tmp_path / "g" / "out").glob("*.parquet"))).write_bytes(b"broken")
    with pytest.raises(Exception, match="CSR-F001"):
        list(stored.search(held["path"], 0, 2, None, held["node_count"], held["size"]))


def test_backends_agree(spark):
    r = np.random.default_rng(2)
    g = graph_from_edges(spark, [(int(a), int(b)) for a, b in r.integers(0, 60, (150, 2))])
    for cap in (None, 0, 1, 17, 1000):
        rows = [bfs(g, [5, 9, 5, 999], 3, cap, ordered=True, backend=b).rows.orderBy("rank").collect() for b in (Backend.ADJACENCY, Backend.DISTRIBUTED)]
        assert rows[0] == rows[1]
    labels = [{tuple(x) for x in analytics.weak_components(g, b).collect()} for b in (Backend.ADJACENCY, Backend.DISTRIBUTED)]
    assert labels[0] == labels[1]
    g.delta.insert(5, 1)
    assert choose(g, Backend.AUTO) is Backend.DISTRIBUTED
    with pytest.raises(InvalidTraversal):
        bfs(g, [5], backend=Backend.ADJACENCY)
    big = graph_from_edges(spark, [(0, 1), (1, 2)])
    assert big.adjacency(limit=1) is None and big.adjacency() is not None
    found = bfs(big, [0], 2)
    assert found.took_us > 0 and found.stats(2).execution_time_us == found.took_us


def test_shards_by_number_and_by_bytes(spark):
    rows = spark.range(1000).selectExpr("id as source", "(id * 7) % 1000 as target")
    assert build_graph(rows, BuildConfig(shards=5))[1].first().shard_count == 5
    g, stats = build_graph(rows, BuildConfig(shard_bytes=1600))
    assert stats.first().shard_count == 10
    where = {x.source: x.shard for x in g.shard_of(spark.range(20).withColumnRenamed("id", "node_id")).collect()}
    assert sorted(where) == list(range(20)) and set(where.values()) <= set(range(10))


def test_changes_during_compaction_stay(spark, monkeypatch):
    finish = graph_module._finish

    def slow(edges, *more):
        g.delta.insert(7, 8)  # after the changes were taken, before the swap
        g.delta.delete(5, 6)
        g.delta.insert(0, 1)
        return finish(edges, *more)

    catalog = GraphCatalog()
    g = graph_from_edges(spark, [(0, 1), (1, 2), (5, 6)])
    catalog.register("live", g)
    g.delta.insert(2, 3)
    g.delta.delete(0, 1)
    monkeypatch.setattr(graph_module, "_finish", slow)
    assert catalog.compact_if_needed("live", CompactionPolicy(1))
    monkeypatch.undo()
    new = catalog.get("live")
    assert edges(new.base) == [(1, 2), (2, 3), (5, 6)]
    assert edges(new.merged()) == [(0, 1), (1, 2), (2, 3), (7, 8)]
    g.delta.insert(9, 9)  # by a writer that still has the old graph
    assert new.has_edge(9, 9)


def test_failed_compaction_loses_nothing(spark, monkeypatch):
    g = graph_from_edges(spark, [(0, 1)])
    g.delta.insert(1, 2)
    monkeypatch.setattr(graph_module, "_finish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        g.compact()
    assert edges(g.merged()) == [(0, 1), (1, 2)]
