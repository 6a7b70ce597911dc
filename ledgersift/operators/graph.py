"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root the smallest node that can be reached.

    Every node takes the smallest label around it, and then the label of its label, until
    none changes. Each round is written to the shared folder; nothing is collected.
    """
    stage = Stage(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage.put(both)
    labels = stage.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(around, labels.node == around.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = stage.put(step.join(up, "root").select("node", F.least("root", "top").alias("root"), "old"))
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels
