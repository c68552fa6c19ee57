"""Edge changes from a stream into a graph.

Each micro-batch is a table (op, source, target, weight) with op ``insert`` or
``delete`` and an order column ``at``; the last change of each edge decides.  A
batch of at most ``max_delta_entries`` edges goes into the delta, a larger one is
merged as a table.  Then the graph is compacted if its policy says so.

With a ``folder`` the sink is durable: a batch is written there before it is
applied, and the base after each compaction, under the number of the last batch
that it holds.  A sink made anew on the folder first restores the base and the
batches after it, so a restarted query goes on where its offsets are, and a batch
that is replayed is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import GraphCatalog
from ..operators.graph import CompactionPolicy, EdgeData, Graph, restored

CHANGES = "op string, source bigint, target bigint, weight double"


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the complete tables ``folder/kind-<n>``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(path)]
    done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n.rpartition("-")[2]) for p, n in names if n.startswith(f"{kind}-") and done(p))


class MutationSink:
    def __init__(self, catalog: GraphCatalog, name: str, policy: CompactionPolicy | None = None, folder: str | None = None):
        self.catalog, self.name, self.policy, self.folder, self._done = catalog, name, policy or CompactionPolicy(), folder, -1
        if folder:
            self._restore()

    def _restore(self) -> None:
        graph = self.catalog.require(self.name).graph
        bases = _numbers(graph.spark, self.folder, "base")
        if bases:
            self._done = bases[-1]
            held = restored(graph.spark.read.parquet(f"{self.folder}/base-{self._done}"), graph.weighted)
            self.catalog.register(self.name, held, dictionary=self.catalog.dictionary(self.name))
        for n in _numbers(graph.spark, self.folder, "batch"):
            if n > self._done:
                self._merge(graph.spark.read.schema(CHANGES).parquet(f"{self.folder}/batch-{n}"), n)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self._done:
            return
        last = batch.dropna(subset=["source", "target", "op"]).groupBy("source", "target").agg(F.max_by(F.struct("op", "weight"), "at").alias("last"))
        last = last.select("last.op", F.col("source").cast("bigint"), F.col("target").cast("bigint"), F.col("last.weight").cast("double").alias("weight"))
        if self.folder:
            last.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
            last = batch.sparkSession.read.schema(CHANGES).parquet(f"{self.folder}/batch-{batch_id}")
        self._merge(last, batch_id)

    def _merge(self, last: DataFrame, batch_id: int) -> None:
        graph = self.catalog.require(self.name).graph
        rows = last.limit(self.policy.max_delta_entries + 1).collect()  # as many as the policy lets the driver hold
        if len(rows) > self.policy.max_delta_entries:
            self.catalog.absorb(self.name, last)
        else:
            for op, source, target, weight in rows:
                if op == "insert":
                    graph.delta.insert(source, target, EdgeData(weight))
                else:
                    graph.delta.delete(source, target)
            if not self.catalog.compact_if_needed(self.name, self.policy):
                self._done = batch_id
                return
        if self.folder:
            self._store(self.catalog.require(self.name).graph, batch_id)
        self._done = batch_id

    def _store(self, graph: Graph, batch_id: int) -> None:
        """Writes the compacted base; what it replaces goes afterwards."""
        spark, folder = graph.spark, self.folder
        graph.base.write.mode("overwrite").parquet(f"{folder}/base-{batch_id}")
        path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for kind in ("base", "batch"):
            for n in _numbers(spark, folder, kind):
                if n < batch_id or kind == "batch" and n == batch_id:
                    files.delete(path(f"{kind}-{n}"), True)


def start_mutations(changes: DataFrame, sink: MutationSink, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes until it is stopped."""
    return changes.writeStream.foreachBatch(sink.apply).option("checkpointLocation", checkpoint).start()
