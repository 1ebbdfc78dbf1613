"""Connected components of a graph of ids, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest id of the node's component; nodes are those of the edges.

    A round takes the least label among a node's neighbours (with map-side combination, so a hub is a
    few rows), then the label of that label, so that rounds grow with the logarithm of the longest
    path. Each round is a table in the shared folder, and only the count of changes reaches the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both, edge_path = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("own"))
        over = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved, new_path = written(
            stepped.join(over, stepped["own"] == over["_n"], "left").select("node", F.col("label").alias("was"), F.least("own", F.coalesce("_l", "own")).alias("label")), "labels"
        )
        changed = not moved.where("was <> label").isEmpty()
        discard(spark, path)
        labels, path = moved.select("node", "label"), new_path
        if not changed:
            discard(spark, edge_path)
            return labels
