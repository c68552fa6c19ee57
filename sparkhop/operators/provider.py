"""All edge definitions of an ontology as one labelled edge table and graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from ..errors import PlanError
from ..functions.ids import checked_id
from ..plans.ontology import Ontology
from ..plans.spec import TraversalSpec
from .graph import Graph, _finish
from .traverse import Reached, traverse

_ID_TYPE: dict[str, DataType] = {"u32": IntegerType(), "u64": LongType(), "u128": BinaryType(), "string": LongType()}


class EdgeTable:
    """One id space for all definitions; no transforms, validity or weights."""

    edge_list_schema = StructType().add("source", LongType(), False).add("target", LongType(), False).add("label", StringType(), False)

    def __init__(self, spark: SparkSession, ontology: Ontology, table: Callable[[str], DataFrame] | None = None):
        ontology.require_valid()
        self.spark, self.ontology, self._table = spark, ontology, table or spark.table
        self._rows: DataFrame | None = None
        self._graph: Graph | None = None

    @property
    def is_materialized(self) -> bool:
        return self._rows is not None

    def materialize(self) -> Graph:
        parts = [
            self._table(e.source)
            .select(checked_id(F.col(e.from_column)).alias("source"), checked_id(F.col(e.to_column)).alias("target"), F.lit(e.label).alias("label"))
            .dropna(subset=["source", "target"])
            for e in self.ontology.edges
        ]
        rows = parts[0] if parts else self.spark.createDataFrame([], self.edge_list_schema)
        for p in parts[1:]:
            rows = rows.unionByName(p)
        self._rows = rows
        self._graph = _finish(rows.select("source", "target", F.lit(None).cast("float").alias("weight"), F.monotonically_increasing_id().alias("seq")), False)
        return self._graph

    def scan(self) -> DataFrame:
        """(source, target, label); projections, filters and limits reach the
        tables below."""
        if self._rows is None:
            raise PlanError(reason="the edge table is not materialized; call materialize() first")
        return self._rows

    @property
    def graph(self) -> Graph | None:
        return self._graph

    def statistics(self) -> DataFrame | None:
        return self._graph.statistics() if self._graph else None

    def labels(self) -> tuple[list[str], list[str]]:
        return [n.label for n in self.ontology.nodes], [e.label for e in self.ontology.edges]

    def node_schema(self, label: str) -> StructType | None:
        node = self.ontology.node(label)
        if node is None:
            return None
        out = StructType().add("node_id", _ID_TYPE[self.ontology.settings.default_node_id_type], False).add("label", StringType(), False)
        for p in node.properties:
            out = out.add(p, StringType(), True)
        return out

    def edge_schema(self, label: str) -> StructType | None:
        edge = self.ontology.edge(label)
        if edge is None:
            return None
        kind = _ID_TYPE[self.ontology.settings.default_node_id_type]
        out = StructType().add("source_id", kind, False).add("target_id", kind, False).add("label", StringType(), False)
        if edge.weight_column:
            out = out.add("weight", DoubleType(), True)
        for p in edge.properties:
            out = out.add(p, StringType(), True)
        return out

    def traverse(self, spec: TraversalSpec) -> Reached:
        if self._graph is None:
            raise PlanError(reason="the edge table is not materialized; call materialize() first")
        return traverse(self._graph, spec)
