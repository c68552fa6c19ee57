"""Table sources and sinks: Parquet, Arrow, Iceberg, and pinned snapshots."""

from __future__ import annotations

import json
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..circuit import CircuitBreaker
from ..errors import ArrowInterchange, ExecutionError, InvalidArrowSchema


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)


def import_batch(array_pointer: int, schema_pointer: int) -> pa.RecordBatch:
    """A record batch from the Arrow C data interface; it must be a struct."""
    try:
        array = pa.Array._import_from_c(array_pointer, schema_pointer)
    except (pa.ArrowInvalid, TypeError) as e:
        raise ArrowInterchange(reason=str(e)) from e
    if not pa.types.is_struct(array.type):
        raise InvalidArrowSchema(reason=f"expected a struct array, got {array.type}")
    return pa.RecordBatch.from_struct_array(array)


def export_batch(batch: pa.RecordBatch, array_pointer: int, schema_pointer: int) -> None:
    """Writes a batch to the Arrow C data interface."""
    batch.to_struct_array()._export_to_c(array_pointer, schema_pointer)


_breaker = CircuitBreaker()


def register_iceberg(spark: SparkSession, name: str, table: str, snapshot_id: int | None = None) -> DataFrame:
    """An Iceberg table as it is, or pinned to a snapshot.  Needs the Iceberg
    connector on the class path; errors count for a circuit breaker."""

    def load() -> DataFrame:
        reader = spark.read.format("iceberg")
        if snapshot_id is not None:
            reader = reader.option("snapshot-id", str(snapshot_id))
        return reader.load(table)

    try:
        df = _breaker.call(load)
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
            raise ExecutionError(reason="the Iceberg connector is not on the class path") from e
        raise
    df.createOrReplaceTempView(name)
    return df


class SnapshotTable:
    """A Parquet table with snapshots: each append adds files and a manifest
    entry, and a reader may pin any entry.  All files are written and listed by
    Spark, so the folder may be in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _entries(self) -> list[dict]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        rows = self.spark.read.text(f"{self.path}/_log").collect()  # one line a snapshot
        return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["id"])

    def append(self, rows: DataFrame) -> int:
        """Adds rows; returns the new snapshot's id."""
        new = (self._entries() or [{"id": 0}])[-1]["id"] + 1
        data = f"{self.path}/data/{new}"
        rows.write.parquet(data)
        entry = json.dumps({"id": new, "data": data, "at": time.time()})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_log")
        return new

    def read(self, snapshot_id: int | None = None) -> DataFrame:
        entries = self._entries()
        if snapshot_id is not None and snapshot_id not in [e["id"] for e in entries]:
            raise ExecutionError(reason=f"snapshot {snapshot_id} not found in {self.path}")
        files = [e["data"] for e in entries if snapshot_id is None or e["id"] <= snapshot_id]
        if not files:
            raise ExecutionError(reason=f"{self.path} has no snapshot")
        return self.spark.read.parquet(*files)

    def register(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        df = self.read(snapshot_id)
        df.createOrReplaceTempView(name)
        return df
