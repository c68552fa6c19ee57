"""Named graphs, their reverse graphs and dictionaries, and a published form
that SQL functions read at planning time."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import PlanError
from ..plans.spec import Direction, TraversalSpec
from . import stored
from .graph import CompactionPolicy, Graph
from .traverse import Reached, traverse

if TYPE_CHECKING:
    from .project import NodeDictionary


@dataclass
class Entry:
    graph: Graph
    reverse: Graph | None = None
    dictionary: NodeDictionary | None = None


class GraphCatalog:
    """A registry.  ``folder``, a path or URI on storage that driver and
    executors share, holds the published snapshots (see ``stored``); without one
    SQL functions are off."""

    def __init__(self, folder: str | None = None):
        self.folder = folder
        self._entries: dict[str, Entry] = {}
        self._lock = threading.RLock()
        if folder:
            stored.make(folder)
            self._write_manifest()

    def register(self, name: str, graph: Graph, reverse: Graph | None = None, dictionary: NodeDictionary | None = None, publish: bool = True) -> Graph | None:
        """Adds or replaces a graph; returns the one it replaces."""
        with self._lock:
            before = self._entries.get(name)
            self._entries[name] = Entry(graph, reverse, dictionary)
        if publish and self.folder:
            self.publish(name)
        return before.graph if before else None

    def deregister(self, name: str) -> Graph | None:
        with self._lock:
            entry = self._entries.pop(name, None)
        if self.folder and entry:
            self._write_manifest(drop=name)
        return entry.graph if entry else None

    def get(self, name: str) -> Graph | None:
        entry = self._entries.get(name)
        return entry.graph if entry else None

    def names(self) -> list[str]:
        return sorted(self._entries)

    def dictionary(self, name: str) -> NodeDictionary | None:
        entry = self._entries.get(name)
        return entry.dictionary if entry else None

    def require(self, name: str) -> Entry:
        entry = self._entries.get(name)
        if entry is None:
            raise PlanError(reason=f"graph_traverse: no graph named '{name}' is registered; available graphs: {self.names()}")
        return entry

    def reverse(self, name: str) -> Graph:
        """The reverse graph, built once: it shows the graph as it was then."""
        entry = self.require(name)
        with self._lock:
            if entry.reverse is None:
                entry.reverse = entry.graph.transpose()
            return entry.reverse

    def compact_if_needed(self, name: str, policy: CompactionPolicy | None = None) -> bool:
        """Swaps in a compacted graph; the dictionary stays and the reverse
        graph is built anew on demand."""
        entry = self._entries.get(name)
        if entry is None or not entry.graph.should_compact(policy or CompactionPolicy()):
            return False
        self._swap(name, entry, entry.graph.compact())
        return True

    def absorb(self, name: str, changes: DataFrame) -> None:
        """Swaps in the graph with a table of changes merged in."""
        entry = self.require(name)
        self._swap(name, entry, entry.graph.absorb(changes))

    def _swap(self, name: str, entry: Entry, new: Graph) -> None:
        """The new graph goes on with the old one's delta, which holds what came
        meanwhile; so a writer that still has the old graph loses nothing."""
        with self._lock:
            new.delta = entry.graph.delta
            self._entries[name] = Entry(new, None, entry.dictionary)
        if self.folder:
            self.publish(name)

    def resolve(self, name: str, start: int | str) -> int:
        """A start node: an id, or a key of the graph's dictionary."""
        if isinstance(start, int):
            return start
        dictionary = self.require(name).dictionary
        if dictionary is None:
            raise PlanError(reason=f"graph_traverse: start node '{start}' is a string but graph '{name}' has no node-key dictionary")
        node = dictionary.id_of(start)
        if node is None:
            raise PlanError(reason=f"graph_traverse: node key '{start}' not found in graph '{name}'")
        return node

    def reach(self, name: str, start: int | str, max_hops: int, max_nodes: int | None = None, direction: str | None = None) -> Reached:
        entry = self.require(name)
        way = Direction.parse(direction)
        spec = TraversalSpec((self.resolve(name, start),), max_hops, max_nodes, direction=way)
        return traverse(entry.graph, spec, self.reverse(name) if way is Direction.INCOMING else entry.reverse)

    def traverse(self, name: str, start: int | str, max_hops: int, max_nodes: int | None = None, direction: str | None = None) -> DataFrame:
        """(node_id, depth, path), distributed: the form for graphs of any size."""
        return self.reach(name, start, max_hops, max_nodes, direction).result()

    def nodes(self, name: str) -> DataFrame:
        """(node_id, node_key) of a string-keyed graph."""
        dictionary = self.require(name).dictionary
        if dictionary is None:
            raise PlanError(reason=f"graph_nodes: graph '{name}' has no node-key dictionary")
        return dictionary.rows

    # published snapshots

    def publish(self, name: str) -> None:
        """Writes a graph for the SQL functions, of any size."""
        entry = self.require(name)
        keys = entry.dictionary.rows if entry.dictionary is not None else None
        self._write_manifest(name, stored.write(entry.graph, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}", keys))

    def _write_manifest(self, name: str | None = None, record: dict | None = None, drop: str | None = None) -> None:
        path = f"{self.folder}/manifest.json"
        with self._lock:
            held = stored.read_json(path)
            if name is not None:
                held[name] = record
            held.pop(drop, None)
            stored.write_json(path, held)
