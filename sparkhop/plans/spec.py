"""What to traverse, and what a traversal has seen."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from ..errors import InvalidTraversal, NotImplementedYet, PlanError


class Algorithm(Enum):
    BFS = "Bfs"
    DFS = "Dfs"
    DIJKSTRA = "Dijkstra"


class Direction(Enum):
    OUTGOING = "Outgoing"
    INCOMING = "Incoming"
    BOTH = "Both"

    @staticmethod
    def parse(text: str | None) -> Direction:
        if text in (None, "out", "outgoing"):
            return Direction.OUTGOING
        if text in ("in", "incoming"):
            return Direction.INCOMING
        raise PlanError(reason=f"graph_traverse: direction must be 'out' or 'in', got '{text}'")


@dataclass(frozen=True)
class TraversalSpec:
    start: tuple[int, ...] = ()
    max_depth: int = 10
    max_nodes: int | None = None
    algorithm: Algorithm = Algorithm.BFS
    direction: Direction = Direction.OUTGOING

    def check(self) -> None:
        """Only breadth-first search along or against the edges runs."""
        if self.algorithm is not Algorithm.BFS:
            raise NotImplementedYet(feature=f"traversal algorithm {self.algorithm.value}")
        if self.direction is Direction.BOTH:
            raise NotImplementedYet(feature="traversal direction Both")
        if self.max_depth < 0 or self.max_nodes is not None and self.max_nodes < 0:
            raise InvalidTraversal(reason="max_depth and max_nodes cannot be negative")

    def describe(self) -> str:
        return f"GraphTraversal: algorithm={self.algorithm.value}, max_depth={self.max_depth}, starts={len(self.start)}"


@dataclass(frozen=True)
class TraversalStats:
    nodes_visited: int
    edges_examined: int
    max_depth_reached: int
    execution_time_us: int = 0
