"""Shared helpers: durable cuts of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``.  A folder of
    our own is used only where the session names none (local tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame's rows, written once to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def compacted(df: DataFrame) -> DataFrame:
    """``checkpointed`` in few files: a sixteenth of the shuffle partitions, or
    one for each core.  For frames with a share of the input's rows that loops
    read again and again: the driver keeps a record of each task, so tasks that
    read almost nothing cost its memory."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) // 16
    out = checkpointed(df.repartition(max(spark.sparkContext.defaultParallelism, parts)))
    collect_garbage(spark)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Between long steps: the driver's JVM collects its garbage and gives free
    heap back, and Spark drops the shuffles and broadcasts that it held."""
    spark.sparkContext._jvm.System.gc()


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A bounded sample: the ``rows`` rows with the smallest hashes of the key.
    In a larger table a limit on the hash first leaves about twice as many, so
    what meets in one task does not follow the number of partitions."""
    n, h = df.count(), F.xxhash64(F.col(key))
    if n > 4 * rows:
        df = df.where(h <= F.lit(int(2 * rows / n * 2**64) - 2**63))
    return df.orderBy(h, key).limit(rows)
