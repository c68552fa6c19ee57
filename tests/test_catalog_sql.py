import random
import uuid

import pytest

from sparkhop.errors import DanglingEdge, DuplicateLabel, ExecutionError, OntologyIo, OntologyParse, PlanError
from sparkhop.functions.sql import register_sql_functions
from sparkhop.operators.catalog import GraphCatalog
from sparkhop.operators.graph import CompactionPolicy, graph_from_edges
from sparkhop.operators.project import register_ontology_graphs
from sparkhop.operators.provider import EdgeTable
from sparkhop.plans import ontology as O
from sparkhop.plans.spec import TraversalSpec

CHAIN = [(0, 1), (1, 2), (2, 3), (1, 3)]
SOCIAL = """
[ontology]
name = "social"
[settings]
default_node_id_type = "string"
[[nodes]]
label = "Person"
source = "people"
id_column = "name"
[[edges]]
label = "FOLLOWS"
source = "follows"
from_node = "Person"
from_column = "follower"
to_node = "Person"
to_column = "followee"
"""


def follows(spark):
    return spark.createDataFrame([("alice", "bob"), ("bob", "carol"), ("alice", "carol")], "follower string, followee string").coalesce(1)


@pytest.fixture()
def catalog(spark, tmp_path):
    c = GraphCatalog(str(tmp_path / "catalog"))
    c.register("g", graph_from_edges(spark, CHAIN))
    register_ontology_graphs(spark, O.from_toml(SOCIAL), c, table=lambda _: follows(spark))
    register_sql_functions(spark, c)
    return c


def rows(spark, text):
    return sorted(tuple(r) for r in spark.sql(text).collect())


def test_sql_traversals(spark, catalog):
    assert rows(spark, "SELECT node_id, depth FROM graph_traverse('g', 0, 2)") == [(0, 0), (1, 1), (2, 2), (3, 2)]
    assert rows(spark, "SELECT node_id FROM graph_traverse('g', 3, 9, 'in')") == [(0,), (1,), (2,), (3,)]
    assert rows(spark, "SELECT count(*) FROM graph_traverse('g', 0, 9, 2)") == [(2,)]
    assert rows(spark, "SELECT count(*) FROM graph_traverse('g', 0, 9, 3, 'outgoing')") == [(3,)]
    assert rows(spark, "SELECT count(*) FROM (SELECT * FROM graph_traverse('g', 0, 9) LIMIT 1)") == [(1,)]
    assert rows(spark, "SELECT max(depth) FROM graph_traverse('g', 0, 9) WHERE depth > 0") == [(2,)]
    assert rows(spark, "SELECT node_id FROM graph_traverse('g', 77, 9)") == []
    assert rows(spark, "SELECT n.node_key, t.depth FROM graph_traverse('social.FOLLOWS', 'alice', 1) t JOIN graph_nodes('social.FOLLOWS') n ON t.node_id = n.node_id") == [("alice", 0), ("bob", 1), ("carol", 1)]
    assert rows(spark, "SELECT * FROM graph_nodes('social.FOLLOWS')") == [(0, "alice"), (1, "bob"), (2, "carol")]
    assert spark.sql("SELECT * FROM graph_traverse('g', 0, 1)").columns == ["node_id", "depth", "path"]


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("graph_traverse('x', 0, 1)", "no graph named 'x' is registered"),
        ("graph_traverse('g', 0)", "expects 3 to 5 arguments"),
        ("graph_traverse(1, 0, 1)", "must be a string literal"),
        ("graph_traverse('g', -1, 1)", "must be a non-negative integer literal"),
        ("graph_traverse('g', 0, 1, 'up')", "direction must be 'out' or 'in'"),
        ("graph_traverse('g', 0, 1, 'in', 'out')", "direction was already given in position 4"),
        ("graph_traverse('g', 'alice', 1)", "no node-key dictionary"),
        ("graph_traverse('social.FOLLOWS', 'dave', 1)", "node key 'dave' not found in graph 'social.FOLLOWS'"),
        ("graph_nodes('g')", "no node-key dictionary"),
        ("graph_nodes('g', 'g')", "graph_nodes expects 1 argument"),
    ],
)
def test_sql_errors_at_planning(spark, catalog, call, said):
    with pytest.raises(Exception, match=said.replace("(", r"\(")):
        spark.sql(f"SELECT * FROM {call}").schema


def test_late_registration_is_visible(spark, catalog):
    catalog.register("late", graph_from_edges(spark, [(0, 1)]))
    assert rows(spark, "SELECT count(*) FROM graph_traverse('late', 0, 1)") == [(2,)]
    catalog.deregister("late")
    with pytest.raises(Exception, match="no graph named"):
        spark.sql("SELECT * FROM graph_traverse('late', 0, 1)").schema


def test_registry(spark):
    c = GraphCatalog()
    g = graph_from_edges(spark, CHAIN)
    assert c.register("b", g) is None and c.register("a", g) is None and c.names() == ["a", "b"]
    assert c.register("a", graph_from_edges(spark, [(0, 1)])) is g
    assert c.get("a").edge_count == 1 and c.get("zz") is None and c.deregister("zz") is None
    assert c.reverse("b") is c.reverse("b")
    with pytest.raises(PlanError):
        c.traverse("zz", 0, 1)
    with pytest.raises(PlanError, match="no node-key dictionary"):
        c.nodes("b")
    with pytest.raises(PlanError, match="direction must be"):
        c.traverse("b", 0, 1, direction="up")


def test_compaction_keeps_names_and_dictionary(spark):
    c = GraphCatalog()
    register_ontology_graphs(spark, O.from_toml(SOCIAL), c, table=lambda _: follows(spark))
    name = "social.FOLLOWS"
    back = c.reverse(name)
    assert not c.compact_if_needed(name) and not c.compact_if_needed("zz")
    c.get(name).delta.insert(2, 0)
    assert c.compact_if_needed(name, CompactionPolicy(1))
    assert c.get(name).edge_count == 4 and c.dictionary(name).key_of(0) == "alice" and c.reverse(name) is not back
    assert {r.node_key for r in c.traverse(name, "carol", 1).join(c.nodes(name), "node_id").collect()} == {"carol", "alice"}
    assert c.dictionary(name).id_of("nobody") is None and len(c.dictionary(name)) == 3


def base(**edge):
    e = dict(label="E", source="t", from_node="N", from_column="src", to_node="N", to_column="dst") | edge
    return O.from_dict({"ontology": {"name": "w"}, "nodes": [{"label": "N", "source": "n", "id_column": "id"}], "edges": [e]})


def test_projections(spark):
    scored = spark.createDataFrame([(0, 1, 2.5), (1, 2, None), (None, 1, 1.0)], "src bigint, dst bigint, score double")
    c = GraphCatalog()
    assert register_ontology_graphs(spark, base(weight_column="score", weight_default=9.0), c, table=lambda _: scored) == ["w.E"]
    assert sorted(r.weight for r in c.get("w.E").base.collect()) == [1.0, 2.5]
    grants = spark.createDataFrame([(0, 1, "2025-01-01", "2026-01-01"), (1, 2, "2026-01-01", None), (2, 3, None, None)], "src bigint, dst bigint, a string, b string")
    for at, n in (("2025-06-15", 1), ("2026-06-15", 1), ("2026-01-01", 1), (None, 3)):
        register_ontology_graphs(spark, base(valid_from_column="a", valid_to_column="b"), c, at, lambda _: grants)
        assert c.get("w.E").edge_count == n
    users = spark.createDataFrame([("user_0", "user_1"), ("a1b2", "user_3")], "src string, dst string")
    o = base()
    o.nodes[0].id_transform = "extract_numeric"
    register_ontology_graphs(spark, o, c, table=lambda _: users)
    assert sorted((r.source, r.target) for r in c.get("w.E").base.collect()) == [(0, 1), (12, 3)]
    o.name = ""
    assert register_ontology_graphs(spark, o, c, table=lambda _: users) == ["E"]
    with pytest.raises(ExecutionError, match="while projecting edge 'E' from table 't'"):
        register_ontology_graphs(spark, o, c, table=lambda _: spark.createDataFrame([("none", "x1")], "src string, dst string"))
    with pytest.raises(ExecutionError, match="while projecting"):
        register_ontology_graphs(spark, o, c, table=lambda _: spark.range(1))


def test_dictionary_order(spark):
    r = random.Random(1)
    pairs = [(f"k{r.randrange(40)}", f"k{r.randrange(40)}") for _ in range(100)]
    c = GraphCatalog()
    frame = spark.createDataFrame(pairs, "follower string, followee string").coalesce(1)
    register_ontology_graphs(spark, O.from_toml(SOCIAL), c, table=lambda _: frame)
    expected = {k: i for i, k in enumerate(dict.fromkeys(x for p in pairs for x in p))}
    assert {x.node_key: x.node_id for x in c.nodes("social.FOLLOWS").collect()} == expected


def test_ontology_files_and_validation(tmp_path):
    (tmp_path / "a.toml").write_text(SOCIAL)
    assert O.from_file(tmp_path / "a.toml").edges[0].weight_default == 1.0
    (tmp_path / "a.json").write_text('{"ontology": {"name": "j"}, "nodes": []}')
    assert O.from_file(tmp_path / "a.json").version == "1.0"
    (tmp_path / "a.txt").write_text('{"nodes": []}')
    assert O.from_file(tmp_path / "a.txt").version == ""
    with pytest.raises(OntologyIo):
        O.from_file(tmp_path / "none.toml")
    for text in ("[[", "[[nodes]]\nlabel = 'x'", "[settings]\ndefault_node_id_type = 'uuid'"):
        with pytest.raises(OntologyParse, match="ONT-E001"):
            O.from_toml(text)
    good = base()
    assert good.validate().is_valid
    twice = base()
    twice.nodes *= 2
    with pytest.raises(DuplicateLabel, match="ONT-E004"):
        twice.require_valid()
    with pytest.raises(DanglingEdge, match="ONT-E003"):
        base(to_node="Z").require_valid()
    warned = base(valid_from_column="a")
    assert warned.validate().is_valid and "ONT-W002" in warned.validate().warnings[0]
    assert not base(valid_from_column="a", partition_column="p").validate().warnings
    for node, edge, ok in (("N", None, True), ("N", "E", False), (None, None, False)):
        o = base()
        o.properties.append(O.ComputedProperty("p", "1", node, edge))
        assert o.validate().is_valid is ok


def test_edge_table(spark):
    frames = {"t": spark.createDataFrame([(1, 2), (2, 3), (1, 3), (None, 1)], "src bigint, dst bigint")}
    t = EdgeTable(spark, base(properties=["since"], weight_column="w"), frames.__getitem__)
    with pytest.raises(PlanError, match="not materialized"):
        t.scan()
    with pytest.raises(PlanError, match="DFN-E001"):
        t.traverse(TraversalSpec((1,)))
    assert not t.is_materialized and t.statistics() is None
    t.materialize()
    assert t.scan().where("label = 'E' AND source = 1").count() == 2 and t.scan().limit(1).count() == 1
    assert t.traverse(TraversalSpec((1,))).rows.count() == 3 and t.statistics().first()[1] == 3
    assert t.labels() == (["N"], ["E"])
    assert [f.name for f in t.edge_schema("E")] == ["source_id", "target_id", "label", "weight", "since"]
    assert t.node_schema("zz") is None and t.node_schema("N")[0].dataType.simpleString() == "bigint"
    wide = base()
    wide.settings.default_node_id_type = "u128"
    assert EdgeTable(spark, wide, frames.__getitem__).node_schema("N")[0].dataType.simpleString() == "binary"
    assert uuid
