"""Registered queries of the graph engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_folder
from ..functions.ids import digits_of, valid_at
from ..functions.sql import register_sql_functions
from ..operators import analytics
from ..operators.catalog import GraphCatalog
from ..operators.graph import BuildConfig, CompactionPolicy, Graph, build_graph
from ..operators.project import register_ontology_graphs
from ..operators.provider import EdgeTable
from ..operators.traverse import Backend, bfs, bfs_direction_optimized
from ..sources import generators
from ..sources.tables import SnapshotTable
from .ontology import EdgeDefinition, NodeDefinition, Ontology, Settings
from .spec import TraversalSpec

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# projections of the test tables

PARTS_SQL = "SELECT DISTINCT l_partkey AS source, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS target FROM lineitem"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digraph of parts: a part points to one for each of its suppliers."""
    parts = table(spark, sf_dir, "part").count()
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.lit(parts)).alias("target")).distinct()


EVENTS_SQL = "SELECT user_id AS source, (event_id * 7 + user_id) % 150 AS target, ts AS valid_from, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 10 DAY END AS valid_to, nullif(value, value) AS nothing, value, event_id FROM events"


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel, timed and weighted edges between users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("source"),
        ((F.col("event_id") * 7 + F.col("user_id")) % 150).alias("target"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("valid_to"),
        "value",
        "event_id",
    )


KEYS_SQL = "SELECT c_name AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-keyed edges customer -> nation -> region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    one = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("a"), F.col("n_name").alias("b"))
    return one.unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("a"), F.col("r_name").alias("b")))


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(part_edges(spark, sf_dir))[0]


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return build_graph(event_edges(spark, sf_dir))[0]


def bfs_sql(edges: str, starts: list[int | str], hops: int, more: str = "", kind: str = "BIGINT", select: str = "SELECT n AS node_id, min(d)::INTEGER AS depth FROM r GROUP BY n") -> str:
    seeds = " UNION ALL ".join(f"SELECT {s!r}::{kind}, 0" for s in starts)
    return f"WITH RECURSIVE e AS ({edges}), r(n, d) AS ({seeds} UNION SELECT e.target, r.d + 1 FROM r JOIN e ON e.source = r.n WHERE r.d < {hops}){more} {select}"


def _khop(hops: int, starts: tuple[int, ...] = (0,)) -> Query:
    return lambda spark, d: bfs(part_graph(spark, d), starts, hops).rows.select("node_id", "depth")


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return bfs(part_graph(spark, d).transpose(), [3], 3).rows


def _bounded(spark: SparkSession, d: str) -> DataFrame:
    found = bfs(part_graph(spark, d), [0], 3, max_nodes=100).rows
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"))


def _phantom(spark: SparkSession, d: str) -> DataFrame:
    edges = part_edges(spark, d).where("source <> 5 and target <> 5")
    return bfs(build_graph(edges)[0], [5], 3).rows


def _changed(spark: SparkSession, d: str) -> Graph:
    """Part edges without the three least targets of node 0, with two new ones."""
    g = part_graph(spark, d)
    for t in [r[0] for r in g.base.where("source = 0").select("target").distinct().orderBy("target").limit(3).collect()]:
        g.delta.delete(0, t)
    g.delta.insert(0, 1999999)
    g.delta.insert(1999999, 1)
    return g


DELTA_SQL = f"SELECT source, target FROM ({PARTS_SQL}) WHERE NOT (source = 0 AND target IN (SELECT DISTINCT target FROM ({PARTS_SQL}) WHERE source = 0 ORDER BY target LIMIT 3)) UNION ALL VALUES (0::BIGINT, 1999999::BIGINT), (1999999::BIGINT, 1::BIGINT)"


def _parallel_tombstone(spark: SparkSession, d: str) -> DataFrame:
    g = event_graph(spark, d)
    s, t = g.base.groupBy("source", "target").count().orderBy(F.desc("count"), "source", "target").select("source", "target").first()
    g.delta.delete(s, t)
    return g.merged().groupBy("source").agg(F.count(F.lit(1)).alias("degree"))


def _ontology(**settings: str) -> Ontology:
    return Ontology(
        name="world",
        version="1.0",
        settings=Settings(**settings),
        nodes=[NodeDefinition("User", "users", "id"), NodeDefinition("Tagged", "users", "id", id_transform="extract_numeric"), NodeDefinition("Place", "places", "name", id_transform="hash_u64")],
        edges=[
            EdgeDefinition("CALLS", "events_edges", "User", "source", "User", "target", weight_column="value", valid_from_column="valid_from", valid_to_column="valid_to"),
            EdgeDefinition("TAGS", "tagged_edges", "Tagged", "a", "Tagged", "b"),
            EdgeDefinition("WITHIN", "key_edges", "Place", "a", "Place", "b"),
        ],
    )


def _tables(spark: SparkSession, d: str) -> Callable[[str], DataFrame]:
    tagged = lambda: event_edges(spark, d).select(F.concat(F.lit("user_"), F.col("source").cast("string")).alias("a"), F.concat(F.lit("u"), F.col("target").cast("string"), F.lit("x")).alias("b"))
    made = {"events_edges": lambda: event_edges(spark, d), "tagged_edges": tagged, "key_edges": lambda: key_edges(spark, d)}
    return lambda name: made[name]()


def _projected(spark: SparkSession, d: str, as_of: str | None = None) -> GraphCatalog:
    catalog = GraphCatalog()
    register_ontology_graphs(spark, _ontology(), catalog, as_of, _tables(spark, d))
    return catalog


def _start_key(spark: SparkSession, d: str) -> str:
    return table(spark, d, "customer").agg(F.min("c_name")).first()[0]


def _dictionary_bfs(spark: SparkSession, d: str) -> DataFrame:
    catalog = _projected(spark, d)
    found = catalog.traverse("world.WITHIN", _start_key(spark, d), 2)
    return found.join(catalog.nodes("world.WITHIN"), "node_id").select("node_key", "depth")


def _edge_table(spark: SparkSession, d: str) -> EdgeTable:
    ontology = Ontology(
        name="m",
        nodes=[NodeDefinition("P", "part", "p_partkey")],
        edges=[EdgeDefinition("NEXT", "part_edges", "P", "source", "P", "target"), EdgeDefinition("CALLS", "event_edges", "P", "source", "P", "target")],
    )
    out = EdgeTable(spark, ontology, lambda name: (part_edges if name == "part_edges" else event_edges)(spark, d).select("source", "target"))
    out.materialize()
    return out


def _blast_join(spark: SparkSession, d: str) -> DataFrame:
    g = part_graph(spark, d)
    reached = bfs(g, [0], 2).rows
    edges = g.merged()
    return reached.join(edges, reached.node_id == edges.source, "left").groupBy("node_id", "depth").agg(F.count("target").alias("out_edges"))


def _recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    part_edges(spark, d).createOrReplaceTempView("part_edge_rows")
    return spark.sql(
        "WITH RECURSIVE r(n, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT e.target, r.d + 1 FROM r JOIN part_edge_rows e ON e.source = r.n WHERE r.d < 2) "
        "SELECT count(DISTINCT n) AS nodes FROM r"
    )


def _published(spark: SparkSession, d: str) -> None:
    catalog = GraphCatalog(f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.register("parts", part_graph(spark, d))
    g = _projected(spark, d)
    catalog.register("places", g.get("world.WITHIN"), dictionary=g.dictionary("world.WITHIN"))
    register_sql_functions(spark, catalog)


def _sql(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        _published(spark, d)
        return spark.sql(text)

    return run


def _sql_keys(spark: SparkSession, d: str) -> DataFrame:
    _published(spark, d)
    key = _start_key(spark, d)
    return spark.sql(f"SELECT n.node_key, t.depth FROM graph_traverse('places', '{key}', 2) t JOIN graph_nodes('places') n ON t.node_id = n.node_id")


def _dobfs(spark: SparkSession, d: str) -> DataFrame:
    g = part_graph(spark, d)
    return bfs_direction_optimized(g, g.transpose(), 0, 3).rows


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    store = SnapshotTable(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    edges = part_edges(spark, d)
    first = store.append(edges.where("source % 2 = 0"))
    store.append(edges.where("source % 2 = 1"))
    return bfs(build_graph(store.read(first))[0], [0], 3).rows


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    e = event_edges(spark, d).withColumn("w", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    g = build_graph(e, BuildConfig(weight="w"))[0]
    return g.merged().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("weight") == 1.0).cast("bigint")).alias("ones"), F.max("weight").cast("double").alias("largest"))


def _shortest(spark: SparkSession, d: str, backend: Backend = Backend.AUTO) -> DataFrame:
    # whole weights, so that sums are exact
    e = part_edges(spark, d).withColumn("w", ((F.col("source") + F.col("target")) % 5 + 1).cast("double"))
    return analytics.shortest_paths(build_graph(e, BuildConfig(weight="w"))[0], 0, backend).select("node_id", "distance")


def _transposed(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d).transpose().merged().select("source", "target")


def _degrees(column: str) -> Query:
    return lambda spark, d: part_graph(spark, d).degrees(column)


def _has_edges(spark: SparkSession, d: str) -> DataFrame:
    g = part_graph(spark, d)
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 7).alias("target"))
    return g.has_edges(asked)


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return part_graph(spark, d).statistics().select("node_count", "edge_count", "delta_entries")


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tables(spark, d)("tagged_edges")
    return tagged.select(digits_of(F.col("a")).alias("source"), digits_of(F.col("b")).alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def _as_of_edges(spark: SparkSession, d: str) -> DataFrame:
    e = event_edges(spark, d)
    return e.where(valid_at(F.col("valid_from"), F.col("valid_to"), AS_OF)).select("source", "target", "event_id")


def _merged_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edge_table(spark, d).scan().groupBy("label").agg(F.count(F.lit(1)).alias("edges"))


def _chained(spark: SparkSession, d: str) -> DataFrame:
    return analytics.khop_by_joins(part_edges(spark, d), 0, 3).agg(F.count(F.lit(1)).alias("nodes"))


def _null_ends(spark: SparkSession, d: str) -> DataFrame:
    e = event_edges(spark, d).withColumns({"source": F.when(F.col("event_id") % 7 != 0, F.col("source")), "target": F.when(F.col("event_id") % 11 != 0, F.col("target"))})
    return build_graph(e)[0].merged().groupBy("source").agg(F.count("target").alias("degree"))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return bfs(part_graph(spark, d), [0], 3).rows.orderBy("depth", "node_id").limit(700)


def _catalog(spark: SparkSession, d: str, graph: Graph) -> GraphCatalog:
    catalog = GraphCatalog()
    catalog.register("parts", graph)
    return catalog


def _reversed(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d, part_graph(spark, d)).reach("parts", 3, 2, direction="in").rows


def _provided(spark: SparkSession, d: str) -> DataFrame:
    return _edge_table(spark, d).traverse(TraversalSpec((0,), 2)).rows


def _memory(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(_changed(spark, d).memory_usage(),)], "memory_bytes bigint")


def _policies(spark: SparkSession, d: str) -> DataFrame:
    g = _changed(spark, d)
    policies = [(n, ratio, g.should_compact(CompactionPolicy(n, ratio))) for n in (4, 5, 6) for ratio in (0.0, 1.0)]
    return spark.createDataFrame(policies, "entries int, ratio double, due boolean")


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    catalog = _catalog(spark, d, _changed(spark, d))
    catalog.compact_if_needed("parts", CompactionPolicy(1))
    catalog.get("parts").delta.insert(2, 1)
    return catalog.get("parts").merged().select("source", "target")


def _absorbed(spark: SparkSession, d: str) -> DataFrame:
    """Each part that is a multiple of 3 loses its edges to multiples of 4 and
    gains one to itself, as one table of changes."""
    edges = part_edges(spark, d).where("source % 3 = 0")
    gone = edges.where("target % 4 = 0 and source <> target").select(F.lit("delete").alias("op"), "source", "target")
    new = edges.select(F.lit("insert").alias("op"), "source", F.col("source").alias("target")).distinct()
    catalog = _catalog(spark, d, part_graph(spark, d))
    catalog.absorb("parts", gone.unionByName(new).withColumn("weight", F.lit(None).cast("double")))
    return catalog.get("parts").merged().select("source", "target")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return generators.uniform(spark, 500, 4, 42).groupBy("source").agg(F.count(F.lit(1)).alias("degree"))


def _rmat(spark: SparkSession, d: str) -> DataFrame:
    return generators.rmat(spark, 10, 8, 42).groupBy("source").agg(F.count(F.lit(1)).alias("degree"))


def _stats_of(spark: SparkSession, d: str) -> DataFrame:
    s = bfs(part_graph(spark, d), [0], 2).stats(2)
    return spark.createDataFrame([(s.nodes_visited, s.edges_examined, s.max_depth_reached)], "nodes_visited bigint, edges_examined bigint, max_depth_reached int")


def _pattern(spark: SparkSession, d: str) -> DataFrame:
    return analytics.two_hops(part_graph(spark, d))


_P = PARTS_SQL

QUERIES: dict[str, Query] = {
    "khop_bfs_1": _khop(1),
    "khop_bfs_2": _khop(2),
    "khop_bfs_3": _khop(3),
    "khop_multi_source": _khop(2, (0, 7, 7, 11)),
    "khop_incoming": _incoming,
    "khop_bounded_count": _bounded,
    "khop_missing_start": lambda s, d: bfs(part_graph(s, d), [999_999_999], 3).rows,
    "khop_phantom_start": _phantom,
    "level_histogram": lambda s, d: bfs(part_graph(s, d), [0], 3).level_histogram(),
    "traversal_stats": _stats_of,
    "out_degree": _degrees("source"),
    "in_degree": _degrees("target"),
    "graph_statistics": _statistics,
    "transpose_edges": _transposed,
    "has_edge_batch": _has_edges,
    "neighbors": lambda s, d: part_graph(s, d).neighbors(3),
    "delta_overlay_edges": lambda s, d: _changed(s, d).merged().select("source", "target"),
    "delta_bfs": lambda s, d: bfs(_changed(s, d), [0], 2).rows,
    "compact_edges": lambda s, d: _changed(s, d).compact().merged().select("source", "target"),
    "parallel_tombstone": _parallel_tombstone,
    "temporal_as_of_edges": _as_of_edges,
    "temporal_as_of_bfs": lambda s, d: _projected(s, d, AS_OF).reach("world.CALLS", 0, 2).rows,
    "weighted_projection_null_default": _weighted,
    "extract_numeric_edges": _numeric,
    "extract_numeric_bfs": lambda s, d: _projected(s, d).reach("world.TAGS", 0, 1).rows,
    "dictionary_bfs_keys": _dictionary_bfs,
    "graph_nodes_keys": lambda s, d: _projected(s, d).nodes("world.WITHIN").select("node_key"),
    "blast_radius_join": _blast_join,
    "blast_radius_decay": lambda s, d: analytics.blast_radius(part_graph(s, d), 0, 2, 0.5),
    "merged_edge_list": lambda s, d: _edge_table(s, d).scan(),
    "merged_edge_list_label_count": _merged_counts,
    "khop_chained_join_count": _chained,
    "khop_recursive_cte_count": _recursive_cte,
    "sql_udtf_traverse": _sql("SELECT node_id, depth FROM graph_traverse('parts', 0, 3) WHERE depth > 0"),
    "sql_udtf_incoming": _sql("SELECT node_id, depth FROM graph_traverse('parts', 3, 3, 'in')"),
    "sql_udtf_limit_count": _sql("SELECT count(*) AS n FROM graph_traverse('parts', 0, 3, 50)"),
    "sql_udtf_keys": _sql_keys,
    "dobfs_equals_bfs": _dobfs,
    "snapshot_pinned_bfs": _snapshot,
    "pattern_two_hops": _pattern,
    "wcc": lambda s, d: analytics.weak_components(part_graph(s, d)),
    "shortest_path_weight": _shortest,
    "null_ends_dropped": _null_ends,
    "ordered_reach_limit": _ordered,
    "catalog_reverse_bfs": _reversed,
    "provider_traversal": _provided,
    "base_neighbors": lambda s, d: _changed(s, d).neighbors(0, base_only=True),
    "graph_memory": _memory,
    "compaction_policy": _policies,
    "catalog_compact_edges": _compacted,
    "changes_merged_as_table": _absorbed,
    "shortest_path_distributed": lambda s, d: _shortest(s, d, Backend.DISTRIBUTED),
    "khop_distributed": lambda s, d: bfs(part_graph(s, d), [0], 3, backend=Backend.DISTRIBUTED).rows,
    "gen_uniform_edges": lambda s, d: generators.uniform(s, 500, 4, 42),
    "gen_rmat_edges": lambda s, d: generators.rmat(s, 6, 8, 42),
    "gen_uniform_shape": _generated,
    "gen_rmat_degrees": _rmat,
}

_E = EVENTS_SQL
_KEY_START = "(SELECT min(c_name) FROM customer)"
_KEYS_BFS = f"WITH e AS ({KEYS_SQL}) SELECT {_KEY_START} AS node_key, 0::INTEGER AS depth UNION ALL SELECT b, 1 FROM e WHERE a = {_KEY_START} UNION ALL SELECT b, 2 FROM e WHERE a IN (SELECT b FROM e WHERE a = {_KEY_START})"
_ALIVE = f"SELECT source, target, event_id FROM ({_E}) WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')"
_REVERSE = f"SELECT target AS source, source AS target FROM ({_P})"
_COUNT = "SELECT count(DISTINCT n) AS nodes FROM r"
_NEW_DELTA = f"{DELTA_SQL} UNION ALL SELECT 2::BIGINT, 1::BIGINT WHERE (2, 1) NOT IN (SELECT (source, target) FROM ({PARTS_SQL}))"


def draws_sql(seed: int, n: int) -> str:
    """x(i, s): the first draws of a seed by the steps of xorshift64."""
    step = lambda x, to, by: f"xor({x}, {to})" if by is None else f"xor({x}, ({x} & {(1 << (64 - by)) - 1}::UBIGINT) << {by})"
    return (
        f"x(i, s) AS (SELECT 0::BIGINT, {seed}::UBIGINT UNION ALL SELECT i + 1, {step('b', '', 17)} FROM "
        f"(SELECT i, {step('a', 'a >> 7', None)} AS b FROM (SELECT i, {step('s', '', 13)} AS a FROM x WHERE i < {n})))"
    )

ORACLE: dict[str, str] = {
    "khop_bfs_1": bfs_sql(_P, [0], 1),
    "khop_bfs_2": bfs_sql(_P, [0], 2),
    "khop_bfs_3": bfs_sql(_P, [0], 3),
    "khop_multi_source": bfs_sql(_P, [0, 7, 11], 2),
    "khop_incoming": bfs_sql(_REVERSE, [3], 3),
    "khop_bounded_count": bfs_sql(_P, [0], 3, select="SELECT least(100, count(*)) AS nodes, (SELECT min(depth) FROM (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS upto FROM (SELECT n, min(d)::INTEGER AS depth FROM r GROUP BY n) GROUP BY depth) WHERE upto >= 100) AS deepest FROM (SELECT n FROM r GROUP BY n)"),
    "khop_missing_start": "SELECT 0::BIGINT AS node_id, 0::INTEGER AS depth WHERE false",
    "khop_phantom_start": "SELECT 5::BIGINT AS node_id, 0::INTEGER AS depth",
    "level_histogram": bfs_sql(_P, [0], 3, select="SELECT depth, count(*) AS nodes FROM (SELECT n, min(d)::INTEGER AS depth FROM r GROUP BY n) GROUP BY depth"),
    "traversal_stats": bfs_sql(_P, [0], 2, ", m AS (SELECT n, min(d)::INTEGER AS depth FROM r GROUP BY n)", select="SELECT (SELECT count(*) FROM m) AS nodes_visited, (SELECT count(*) FROM e JOIN m ON e.source = m.n WHERE m.depth < 2) AS edges_examined, (SELECT max(depth) FROM m) AS max_depth_reached"),
    "out_degree": f"WITH e AS ({_P}), n AS (SELECT unnest(range((SELECT greatest(max(source), max(target)) + 1 FROM e)::BIGINT)) AS node_id) SELECT node_id, count(e.target) AS degree FROM n LEFT JOIN e ON e.source = node_id GROUP BY node_id",
    "in_degree": f"WITH e AS ({_P}), n AS (SELECT unnest(range((SELECT greatest(max(source), max(target)) + 1 FROM e)::BIGINT)) AS node_id) SELECT node_id, count(e.source) AS degree FROM n LEFT JOIN e ON e.target = node_id GROUP BY node_id",
    "graph_statistics": f"SELECT greatest(max(source), max(target)) + 1 AS node_count, count(*) AS edge_count, 0::BIGINT AS delta_entries FROM ({_P})",
    "transpose_edges": _REVERSE,
    "has_edge_batch": f"SELECT s_suppkey AS source, s_suppkey * 7 AS target, (s_suppkey, s_suppkey * 7) IN (SELECT (source, target) FROM ({_P})) AS found FROM supplier",
    "neighbors": f"SELECT target FROM ({_P}) WHERE source = 3",
    "delta_overlay_edges": DELTA_SQL,
    "delta_bfs": bfs_sql(DELTA_SQL, [0], 2),
    "compact_edges": DELTA_SQL,
    "parallel_tombstone": f"WITH e AS ({_E}), top AS (SELECT source, target FROM e GROUP BY source, target ORDER BY count(*) DESC, source, target LIMIT 1) SELECT source, count(*) AS degree FROM e WHERE (source, target) NOT IN (SELECT (source, target) FROM top) GROUP BY source",
    "temporal_as_of_edges": _ALIVE,
    "temporal_as_of_bfs": bfs_sql(f"SELECT source, target FROM ({_ALIVE})", [0], 2),
    "weighted_projection_null_default": f"SELECT source, count(*) AS n, sum((coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 1.0)::FLOAT = 1.0)::INTEGER)::BIGINT AS ones, max(coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 1.0)::FLOAT)::DOUBLE AS largest FROM ({_E}) GROUP BY source",
    "extract_numeric_edges": f"SELECT regexp_replace('user_' || source, '[^0-9]', '', 'g')::BIGINT AS source, regexp_replace('u' || target || 'x', '[^0-9]', '', 'g')::BIGINT AS target, count(*) AS n FROM ({_E}) GROUP BY ALL",
    "extract_numeric_bfs": bfs_sql(_E, [0], 1),
    "dictionary_bfs_keys": _KEYS_BFS,
    "graph_nodes_keys": f"SELECT a AS node_key FROM ({KEYS_SQL}) UNION SELECT b FROM ({KEYS_SQL})",
    "blast_radius_join": bfs_sql(_P, [0], 2, select="SELECT m.n AS node_id, m.depth, count(e.target) AS out_edges FROM (SELECT n, min(d)::INTEGER AS depth FROM r GROUP BY n) m LEFT JOIN e ON e.source = m.n GROUP BY m.n, m.depth"),
    "blast_radius_decay": bfs_sql(_P, [0], 2, select="SELECT n AS node_id, min(d)::INTEGER AS depth, pow(0.5, min(d)) AS score FROM r GROUP BY n"),
    "merged_edge_list": f"SELECT source, target, 'NEXT' AS label FROM ({_P}) UNION ALL SELECT source, target, 'CALLS' FROM ({_E})",
    "merged_edge_list_label_count": f"SELECT label, count(*) AS edges FROM (SELECT 'NEXT' AS label FROM ({_P}) UNION ALL SELECT 'CALLS' FROM ({_E})) GROUP BY label",
    "khop_chained_join_count": f"WITH e AS ({_P}), a AS (SELECT DISTINCT target FROM e WHERE source = 0), b AS (SELECT DISTINCT e.target FROM e JOIN a ON e.source = a.target), c AS (SELECT DISTINCT e.target FROM e JOIN b ON e.source = b.target) SELECT count(*) AS nodes FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)",
    "khop_recursive_cte_count": bfs_sql(_P, [0], 2, select=_COUNT),
    "sql_udtf_traverse": bfs_sql(_P, [0], 3, select="SELECT n AS node_id, min(d)::INTEGER AS depth FROM r GROUP BY n HAVING min(d) > 0"),
    "sql_udtf_incoming": bfs_sql(_REVERSE, [3], 3),
    "sql_udtf_limit_count": bfs_sql(_P, [0], 3, select="SELECT least(50, count(DISTINCT n)) AS n FROM r"),
    "sql_udtf_keys": _KEYS_BFS,
    "dobfs_equals_bfs": bfs_sql(_P, [0], 3),
    "snapshot_pinned_bfs": bfs_sql(f"SELECT * FROM ({_P}) WHERE source % 2 = 0", [0], 3),
    "pattern_two_hops": f"SELECT x.source AS a, x.target AS b, y.target AS c FROM ({_P}) x JOIN ({_P}) y ON x.target = y.source",
    "wcc": f"WITH RECURSIVE e AS ({_P}), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), n AS (SELECT unnest(range((SELECT greatest(max(source), max(target)) + 1 FROM e)::BIGINT)) AS node_id), z(a, c) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT u.b, 0 FROM z JOIN u ON u.a = z.a) SELECT node_id, coalesce(z.c, CASE WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.a = node_id) THEN node_id END) AS component FROM n LEFT JOIN z ON z.a = node_id",
    "shortest_path_weight": f"WITH RECURSIVE e AS (SELECT source, target, ((source + target) % 5 + 1)::DOUBLE AS w FROM ({_P})), r(n, c) AS (SELECT 0::BIGINT, 0::DOUBLE UNION SELECT e.target, r.c + e.w FROM r JOIN e ON e.source = r.n WHERE r.c + e.w <= 60) SELECT n AS node_id, min(c) AS distance FROM r GROUP BY n",
    "null_ends_dropped": f"SELECT source, count(*) AS degree FROM ({_E}) WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY source",
    "ordered_reach_limit": bfs_sql(_P, [0], 3, select="SELECT n AS node_id, min(d)::INTEGER AS depth FROM r GROUP BY n ORDER BY depth, node_id LIMIT 700"),
    "catalog_reverse_bfs": bfs_sql(_REVERSE, [3], 2),
    "provider_traversal": bfs_sql(f"{_P} UNION ALL SELECT source, target FROM ({_E})", [0], 2),
    "base_neighbors": f"SELECT target FROM ({_P}) WHERE source = 0",
    "graph_memory": f"SELECT (4 * (greatest(max(source), max(target)) + 2) + 4 * count(*) + 2 * 48 + 3 * 16)::BIGINT AS memory_bytes FROM ({_P})",
    "compaction_policy": "SELECT entries::INTEGER AS entries, ratio::DOUBLE AS ratio, entries <= 5 OR ratio = 0 AS due FROM (VALUES (4), (5), (6)) a(entries), (VALUES (0), (1)) b(ratio)",
    "catalog_compact_edges": _NEW_DELTA,
    "changes_merged_as_table": f"SELECT source, target FROM ({_P}) WHERE NOT (source % 3 = 0 AND target % 4 = 0 AND source <> target) UNION SELECT source, source FROM ({_P}) WHERE source % 3 = 0",
    "shortest_path_distributed": f"WITH RECURSIVE e AS (SELECT source, target, ((source + target) % 5 + 1)::DOUBLE AS w FROM ({_P})), r(n, c) AS (SELECT 0::BIGINT, 0::DOUBLE UNION SELECT e.target, r.c + e.w FROM r JOIN e ON e.source = r.n WHERE r.c + e.w <= 60) SELECT n AS node_id, min(c) AS distance FROM r GROUP BY n",
    "khop_distributed": bfs_sql(_P, [0], 3),
    "gen_uniform_edges": f"WITH RECURSIVE {draws_sql(42, 2000)} SELECT ((i - 1) // 4)::BIGINT AS source, (s % 500)::BIGINT AS target FROM x WHERE i > 0",
    "gen_rmat_edges": f"WITH RECURSIVE {draws_sql(42, 3072)}, q AS (SELECT (i - 1) // 6 AS e, 1 << (5 - (i - 1) % 6) AS place, (s & 65535 >= {generators.RMAT_LIMITS[0]})::INTEGER + (s & 65535 >= {generators.RMAT_LIMITS[1]})::INTEGER + (s & 65535 >= {generators.RMAT_LIMITS[2]})::INTEGER AS quadrant FROM x WHERE i > 0) SELECT sum((quadrant >> 1) * place)::BIGINT AS source, sum((quadrant & 1) * place)::BIGINT AS target FROM q GROUP BY e",
    "gen_uniform_shape": "SELECT unnest(range(500))::BIGINT AS source, 4::BIGINT AS degree",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops from part 0, with the parts' names and their out-degrees."""
    g = part_graph(spark, sf_dir)
    reached = bfs(g, [0], 3).rows
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_name")
    return reached.join(parts, "node_id", "left").join(g.degrees(), "node_id", "left").select("node_id", "depth", "p_name", "degree")
