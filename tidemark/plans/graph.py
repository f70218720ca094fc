"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (smallest node that its links reach) for the ends of ``edges`` (a, b).

    Every round each node takes the smallest label among itself and its neighbours, then the label's own label; the
    round's table is written, so lineage stays short. Partial minima are formed before the shuffle, so a node of very
    many links costs one row a partition.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), f"{name}_edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}_0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, "a").select("a", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("a").alias("to"), F.col("root").alias("far"))
        nearer = lower.join(jump, "to", "left").select("a", F.least("to", F.coalesce("far", "to")).alias("root"), "was")
        moved = written(nearer, f"{name}_{step}")
        labels = moved.select("a", "root")
        if moved.where("root <> was").isEmpty():
            return labels.withColumnRenamed("a", "node")
