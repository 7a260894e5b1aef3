"""Connected components of an edge table, by least labels and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, stored_at


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node of ``edges`` (columns a, b).

    Each round a node takes the least label of itself and its neighbours, then the label of that label, so
    a chain's labels travel in doubling steps. All of it is joins and grouped minima over written tables, each
    removed once the next one is there; rounds go on until nothing changes. No edges: no rows."""
    spark = edges.sparkSession
    pairs = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both, edges_at = stored_at(pairs, "edges")
    least = F.least(F.min("b"), F.min("a")).alias("component")
    labels, labels_at = stored_at(both.groupBy(F.col("a").alias("node")).agg(least), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        lower = F.least("component", "c").alias("component")
        hooked, hooked_at = stored_at(labels.join(near, "node").select("node", lower, F.col("component").alias("was")), "labels")
        of = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jump = F.least("component", "next").alias("component")
        jumped, jumped_at = stored_at(hooked.join(of, "component").select("node", jump, "was"), "labels")
        remove(spark, labels_at, hooked_at)
        labels, labels_at = jumped.select("node", "component"), jumped_at
        if jumped.where("component <> was").isEmpty():
            remove(spark, edges_at)
            return labels
