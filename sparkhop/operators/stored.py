"""Published graphs: what the SQL functions read, without a Spark job.

A published graph is two Parquet tables, edges sorted by source and edges sorted
by target, and for string keys a third, sorted by key.  Spark writes them in
parallel; a search reads, level by level, the row groups whose range can hold
the frontier.  So there is no limit on edges, and what a search holds is a bit
for each node and one level.  Files go through Arrow's file systems: any folder
that both Spark and Arrow can name (a path, file://, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame

from ..errors import ShardCorruption
from .graph import Graph

#: Frontier nodes that one read of the edges asks for.
ASKED = 1 << 18


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """Hadoop writes local folders as file:/folder."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def make(folder: str) -> None:
    files, path = place(folder)
    files.create_dir(path, recursive=True)


def read_json(uri: str) -> dict:
    files, path = place(uri)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def write_json(uri: str, held: dict) -> None:
    """Readers see the old or the new file."""
    files, path = place(uri)
    with files.open_output_stream(path + ".new") as f:
        f.write(json.dumps(held).encode())
    files.move(path + ".new", path)


def write(graph: Graph, folder: str, keys: DataFrame | None = None) -> dict:
    """Stores a graph's merged edges; gives its entry in the manifest."""
    edges = graph.merged().select("source", "target", "seq")
    edges.repartitionByRange("source").sortWithinPartitions("source", "seq").write.parquet(f"{folder}/out")
    edges.repartitionByRange("target").sortWithinPartitions("target", "seq").write.parquet(f"{folder}/in")
    if keys is not None:
        keys.select("node_id", "node_key").repartitionByRange("node_key").sortWithinPartitions("node_key").write.parquet(f"{folder}/keys")
    # a node that only an insertion names is no start, but can be reached
    size = max(graph.node_count, graph.largest_inserted() + 1)
    return {"path": folder, "node_count": graph.node_count, "size": size, "keys": keys is not None}


def table(uri: str) -> ds.Dataset:
    files, path = place(uri)
    try:
        return ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=False)
    except (OSError, pa.ArrowInvalid) as e:
        raise ShardCorruption(path=uri, reason=str(e).splitlines()[0]) from e


def node_of(folder: str, key: str) -> int | None:
    """The id of a node key; sorted files, so few row groups are read."""
    found = table(f"{folder}/keys").to_table(columns=["node_id"], filter=pc.field("node_key") == key)
    return found.column(0)[0].as_py() if found.num_rows else None


class Edges:
    """The edges out of (or into) nodes of a stored graph."""

    def __init__(self, folder: str, reverse: bool = False):
        self.folder = f"{folder}/{'in' if reverse else 'out'}"
        self.data = table(self.folder)
        self.near, self.far = ("target", "source") if reverse else ("source", "target")
        if not {"source", "target", "seq"} <= set(self.data.schema.names) and self.data.files:
            raise ShardCorruption(path=self.folder, reason=f"its columns are {self.data.schema.names}")

    def ahead(self, frontier: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Unseen neighbours of a frontier, each once, by the place of the
        first parent and then by the edges' order."""
        found = [np.zeros((0, 3), np.int64)]  # (node, place of the parent, seq)
        order = np.argsort(frontier, kind="stable")
        for at in range(0, len(frontier), ASKED):
            part = order[at : at + ASKED]
            nodes = frontier[part]
            near = pc.field(self.near)
            wanted = (near >= int(nodes[0])) & (near <= int(nodes[-1])) & near.isin(pa.array(nodes))
            try:
                for batch in self.data.to_batches(columns=["source", "target", "seq"], filter=wanted):
                    a, b, q = (batch.column(c).to_numpy() for c in (self.near, self.far, "seq"))
                    new = ~seen[b]
                    if new.any():
                        a, b, q = a[new], b[new], q[new]
                        found.append(np.stack([b, part[np.searchsorted(nodes, a)], q], 1))
            except (OSError, pa.ArrowInvalid) as e:
                raise ShardCorruption(path=self.folder, reason=str(e).splitlines()[0]) from e
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1]))]
        return rows[np.sort(np.unique(rows[:, 0], return_index=True)[1]), 0]


def search(folder: str, start: int, max_depth: int, max_nodes: int | None, node_count: int, size: int, reverse: bool = False):
    """(nodes, depth) of each level, in order of discovery."""
    if not 0 <= start < node_count or max_nodes == 0:
        return
    edges, total = Edges(folder, reverse), 1
    seen = np.zeros(size, bool)
    frontier = np.array([start], np.int64)
    seen[frontier] = True
    yield frontier, 0
    for depth in range(1, max_depth + 1):
        if max_nodes is not None and total >= max_nodes:
            return
        frontier = edges.ahead(frontier, seen)
        if max_nodes is not None:
            frontier = frontier[: max_nodes - total]
        if not len(frontier):
            return
        seen[frontier] = True
        total += len(frontier)
        yield frontier, depth
