"""Declarative mapping of tables to a graph: TOML or JSON, and its validation."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..errors import ComputedPropertyTarget, DanglingEdge, DuplicateLabel, GraphError, OntologyIo, OntologyParse

ID_TYPES = ("u32", "u64", "u128", "string")
TRANSFORMS = ("passthrough", "hash_u64", "hash_u32", "uuid_to_u128", "extract_numeric")


@dataclass
class Settings:
    default_node_id_type: str = "u64"
    edge_direction: str = "directed"
    allow_self_loops: bool = False
    allow_parallel_edges: bool = True


@dataclass
class NodeDefinition:
    label: str
    source: str
    id_column: Any  # a name, or {columns = [..], separator = ".."}
    id_transform: str = "passthrough"
    properties: list[str] = field(default_factory=list)
    filter: str | None = None


@dataclass
class EdgeDefinition:
    label: str
    source: str
    from_node: str
    from_column: str
    to_node: str
    to_column: str
    properties: list[str] = field(default_factory=list)
    weight_column: str | None = None
    weight_default: float = 1.0
    implicit: bool = False
    skip_null_targets: bool = True
    valid_from_column: str | None = None
    valid_to_column: str | None = None
    partition_column: str | None = None


@dataclass
class ComputedProperty:
    name: str
    expression: str
    node: str | None = None
    edge: str | None = None
    materialized: bool = False


@dataclass
class Validation:
    errors: list[GraphError] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


@dataclass
class Ontology:
    name: str = ""
    version: str = ""
    description: str = ""
    settings: Settings = field(default_factory=Settings)
    nodes: list[NodeDefinition] = field(default_factory=list)
    edges: list[EdgeDefinition] = field(default_factory=list)
    properties: list[ComputedProperty] = field(default_factory=list)

    def validate(self) -> Validation:
        """All problems, in this order: labels, references, computed
        properties; temporal edges without a partition column only warn."""
        out = Validation()
        for kind, labels in (("node", [n.label for n in self.nodes]), ("edge", [e.label for e in self.edges])):
            out.errors += [DuplicateLabel(kind=kind, label=x) for i, x in enumerate(labels) if x in labels[:i]]
        known = {n.label for n in self.nodes}
        out.errors += [DanglingEdge(edge=e.label, node=n) for e in self.edges for n in (e.from_node, e.to_node) if n not in known]
        out.errors += [ComputedPropertyTarget(name=p.name) for p in self.properties if (p.node is None) == (p.edge is None)]
        out.warnings += [f"ONT-W002: Temporal edge '{e.label}' has no partition hint; full scans may occur" for e in self.edges if e.valid_from_column and not e.partition_column]
        return out

    def require_valid(self) -> None:
        for e in self.validate().errors:
            raise e

    def node(self, label: str) -> NodeDefinition | None:
        return next((n for n in self.nodes if n.label == label), None)

    def edge(self, label: str) -> EdgeDefinition | None:
        return next((e for e in self.edges if e.label == label), None)


def _make(kind: type, raw: dict[str, Any], where: str) -> Any:
    known = {f.name for f in fields(kind)}
    try:
        return kind(**{k: v for k, v in raw.items() if k in known})
    except TypeError as e:
        raise OntologyParse(kind=where, reason=str(e)) from e


def from_dict(raw: dict[str, Any]) -> Ontology:
    head = raw.get("ontology")
    settings = _make(Settings, raw.get("settings", {}), "settings")
    if settings.default_node_id_type not in ID_TYPES:
        raise OntologyParse(kind="settings", reason=f"unknown id type '{settings.default_node_id_type}', expected one of {ID_TYPES}")
    if settings.edge_direction not in ("directed", "undirected"):
        raise OntologyParse(kind="settings", reason=f"unknown edge direction '{settings.edge_direction}'")
    nodes = [_make(NodeDefinition, n, "nodes") for n in raw.get("nodes", [])]
    for n in nodes:
        if n.id_transform not in TRANSFORMS:
            raise OntologyParse(kind="nodes", reason=f"unknown id transform '{n.id_transform}'")
    return Ontology(
        name=(head or {}).get("name", ""),
        version=(head or {}).get("version", "1.0") if head is not None else "",
        description=(head or {}).get("description", ""),
        settings=settings,
        nodes=nodes,
        edges=[_make(EdgeDefinition, e, "edges") for e in raw.get("edges", [])],
        properties=[_make(ComputedProperty, p, "properties") for p in raw.get("properties", [])],
    )


def from_toml(text: str) -> Ontology:
    try:
        return from_dict(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise OntologyParse(kind="TOML", reason=str(e)) from e


def from_json(text: str) -> Ontology:
    try:
        return from_dict(json.loads(text))
    except json.JSONDecodeError as e:
        raise OntologyParse(kind="JSON", reason=str(e)) from e


def from_file(path: str | Path) -> Ontology:
    """By its extension; another extension is tried as TOML, then as JSON."""
    path = Path(path)
    try:
        text = path.read_text()
    except OSError as e:
        raise OntologyIo(reason=str(e)) from e
    if path.suffix == ".toml":
        return from_toml(text)
    if path.suffix == ".json":
        return from_json(text)
    try:
        return from_toml(text)
    except OntologyParse:
        return from_json(text)
