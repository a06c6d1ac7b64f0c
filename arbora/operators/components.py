"""Connected components of an edge table by spreading the smallest label, with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable from each end of the edges (a, b).

    A round takes the smallest label among a node and its neighbours, then the label of that
    label. Each round is checkpointed, so a lost executor costs one round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = cut(low.join(jump, F.col("low") == F.col("at"), "left").select("node", "old", F.coalesce("to", "low").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
