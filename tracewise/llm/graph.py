"""Connected components of an edge table by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable. Each round is written, so a lost executor costs one round at most.

    A round gives each node the least label among its neighbours and itself, then the label
    of that label. The number of rounds goes with the logarithm of a component's width.
    """
    both = store(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = store(both.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("node"), F.least("x", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").select(F.col("x").alias("node"), "label")
        least = near.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        old = labels.select("node", F.col("label").alias("was"))
        step = store(new.join(old, "node"), "labels")
        labels = step.select("node", "label")
        if not step.where("label != was").limit(1).count():
            return labels
