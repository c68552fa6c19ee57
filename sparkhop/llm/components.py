"""Connected components of a link table, by iterated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compacted


#: Label steps in one plan, between two checkpoints.
STEPS = 2


def _step(label: DataFrame, both: DataFrame) -> DataFrame:
    near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
    new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "least").alias("least"))
    own = label.select(F.col("node").alias("least"), F.col("component").alias("further"))
    return new.join(own, "least", "left").select("node", F.least("least", F.coalesce("further", "least")).alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node
    that can be reached.  Each step takes the least label among neighbours and
    then the label's own label, until nothing changes; minima over a node are
    pre-aggregated before they are exchanged.  The two joins have one row for each
    node or label on one side; a node with very many links, or a label of very many
    nodes, is split by Spark's skew join, as both sides come from exchanges.

    Defined results: links with a null end are left out, links of a node to itself
    too, so a node that has no others is not in the result; repeated links count
    once; no links give no rows; further columns are not read."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = compacted(both.where("a <> b").distinct())
    label = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
    while True:
        new = label
        for _ in range(STEPS):
            new = _step(new, both)
        before = label.select("node", F.col("component").alias("before"))
        new = compacted(new.join(before, "node").select("node", "component", "before"))
        label = new.select("node", "component")
        if new.where("component <> before").isEmpty():
            return label
