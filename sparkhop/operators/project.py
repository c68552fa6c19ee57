"""Projection of ordinary tables to graphs, as an ontology declares them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed, numbered
from ..errors import ExecutionError, GraphError
from ..functions.ids import checked_id, digits_of, valid_at, weight_of
from ..plans.ontology import EdgeDefinition, Ontology
from .catalog import GraphCatalog
from .graph import Graph, _finish

HASHED = {"hash_u64", "hash_u32", "uuid_to_u128"}


class NodeDictionary:
    """Dense ids of string keys, from 0 in the order of first appearance."""

    def __init__(self, rows: DataFrame):
        self.rows = rows  # node_id, node_key

    def id_of(self, key: str) -> int | None:
        found = self.rows.where(F.col("node_key") == key).select("node_id").first()
        return None if found is None else found[0]

    def key_of(self, node: int) -> str | None:
        found = self.rows.where(F.col("node_id") == node).select("node_key").first()
        return None if found is None else found[0]

    def __len__(self) -> int:
        return self.rows.count()


def encode_keys(edges: DataFrame) -> tuple[DataFrame, NodeDictionary]:
    """(source, target, weight, seq) of an edge table keyed by strings (from_key,
    to_key, weight, seq), and its dictionary."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_key").alias("key"), (F.col("seq") * 2).alias("at")), F.struct(F.col("to_key").alias("key"), (F.col("seq") * 2 + 1).alias("at")))).alias("e"))
    keys = ends.groupBy(F.col("e.key").alias("node_key")).agg(F.min("e.at").alias("at"))
    rows = checkpointed(numbered(keys, ["at"], "node_id").select("node_id", "node_key"))
    a = rows.select(F.col("node_key").alias("from_key"), F.col("node_id").alias("source"))
    b = rows.select(F.col("node_key").alias("to_key"), F.col("node_id").alias("target"))
    return edges.join(a, "from_key").join(b, "to_key").select("source", "target", "weight", "seq"), NodeDictionary(rows)


def needs_dictionary(ontology: Ontology, edge: EdgeDefinition) -> bool:
    transforms = {n.label: n.id_transform for n in ontology.nodes}
    return ontology.settings.default_node_id_type == "string" or bool({transforms.get(edge.from_node), transforms.get(edge.to_node)} & HASHED)


def project_edge(table: DataFrame, ontology: Ontology, edge: EdgeDefinition, as_of: str | None = None) -> tuple[Graph, NodeDictionary | None]:
    """The graph of one edge definition.  Both ends share one id space; rows
    with a null end are dropped; validity counts only if a time is given."""
    if as_of is not None and edge.valid_from_column:
        to = F.col(edge.valid_to_column) if edge.valid_to_column else None
        table = table.where(valid_at(F.col(edge.valid_from_column), to, as_of))
    weight = weight_of(F.col(edge.weight_column)) if edge.weight_column else F.lit(None).cast("float")
    if needs_dictionary(ontology, edge):
        keyed = table.select(F.col(edge.from_column).cast("string").alias("from_key"), F.col(edge.to_column).cast("string").alias("to_key"), weight.alias("weight"))
        keyed = checkpointed(keyed.dropna(subset=["from_key", "to_key"]).withColumn("seq", F.monotonically_increasing_id()))
        rows, dictionary = encode_keys(keyed)
        return _finish(rows, edge.weight_column is not None), dictionary
    transforms = {n.label: n.id_transform for n in ontology.nodes}

    def end(column: str, node: str) -> F.Column:
        c = F.col(column)
        return checked_id(digits_of(c) if transforms.get(node) == "extract_numeric" else c)

    rows = table.select(end(edge.from_column, edge.from_node).alias("source"), end(edge.to_column, edge.to_node).alias("target"), weight.alias("weight"))
    rows = rows.dropna(subset=["source", "target"]).withColumn("seq", F.monotonically_increasing_id())
    return _finish(rows, edge.weight_column is not None), None


def graph_name(ontology: Ontology, edge: EdgeDefinition) -> str:
    return f"{ontology.name}.{edge.label}" if ontology.name else edge.label


def register_ontology_graphs(spark: SparkSession, ontology: Ontology, catalog: GraphCatalog, as_of: str | None = None, table: Callable[[str], DataFrame] | None = None) -> list[str]:
    """Registers a graph for each edge definition and returns their names in
    order.  An invalid ontology registers nothing; a table that cannot be
    projected leaves the graphs before it registered."""
    ontology.require_valid()
    names = []
    for edge in ontology.edges:
        try:
            graph, dictionary = project_edge((table or spark.table)(edge.source), ontology, edge, as_of)
        except GraphError:
            raise
        except Exception as e:
            raise ExecutionError(reason=f"while projecting edge '{edge.label}' from table '{edge.source}': {e}") from e
        names.append(graph_name(ontology, edge))
        catalog.register(names[-1], graph, dictionary=dictionary)
    return names
