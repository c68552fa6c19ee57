import heapq
from collections import defaultdict

import pytest

from sparkhop import errors
from sparkhop.operators import analytics
from sparkhop.operators.graph import BuildConfig, build_graph, graph_from_edges
from sparkhop.operators.traverse import Backend
from sparkhop.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small part and lineitem table, and its edges."""
    d = str(tmp_path_factory.mktemp("tables"))
    pairs = [(p, s) for p in range(60) for s in (p % 7 + 1, p % 11 + 3)] + [(4, 5), (4, 5)]
    spark.createDataFrame([(p,) for p in range(60)], "p_partkey bigint").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(pairs, "l_partkey bigint, l_suppkey bigint").write.parquet(f"{d}/lineitem.parquet")
    return d, {(p, (p * 7 + s) % 60) for p, s in pairs}


def test_two_hops_over_the_whole_graph(spark, tables):
    d, edges = tables
    want = sorted((a, b, c) for a, b in edges for x, c in edges if x == b)
    assert sorted(tuple(r) for r in queries.QUERIES["pattern_two_hops"](spark, d).collect()) == want


def test_shortest_paths_at_all_distances(spark, tables):
    d, edges = tables
    out, best, heap = defaultdict(list), {}, [(0.0, 0)]
    for a, b in edges:
        out[a].append((b, (a + b) % 5 + 1.0))
    while heap:
        at, n = heapq.heappop(heap)
        if n not in best:
            best[n] = at
            for b, w in out[n]:
                heapq.heappush(heap, (at + w, b))
    assert max(best.values()) > 6
    assert {r.node_id: r.distance for r in queries.QUERIES["shortest_path_weight"](spark, d).collect()} == best
    g = build_graph(spark.createDataFrame([(a, b, (a + b) % 5 + 1.0) for a, b in edges], "source bigint, target bigint, w double"), BuildConfig(weight="w"))[0]
    for backend in (Backend.ADJACENCY, Backend.DISTRIBUTED):
        rows = analytics.shortest_paths(g, 0, backend).collect()
        assert {r.node_id: r.distance for r in rows} == best
        assert all(r.node_id == 0 or (r.parent, r.node_id) in edges and best[r.parent] + (r.parent + r.node_id) % 5 + 1 == r.distance for r in rows)


def test_shortest_paths_end_where_distances_stand(spark):
    n = 1500
    chain = graph_from_edges(spark, [(i, i + 1) for i in range(n)])
    assert {r.node_id: r.distance for r in analytics.shortest_paths(chain, 0).collect()} == {i: float(i) for i in range(n + 1)}
    loop = graph_from_edges(spark, [(0, 1, 1.0), (1, 2, -3.0), (2, 1, 1.0)])
    for backend in (Backend.ADJACENCY, Backend.DISTRIBUTED):
        with pytest.raises(errors.InvalidTraversal):
            analytics.shortest_paths(loop, 0, backend)
