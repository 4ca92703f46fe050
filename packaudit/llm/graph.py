"""Connected components of a graph of any size, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packaudit.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node it reaches.

    Each round gives a node the smallest label of its neighbours and then its label's label, so the distance a label
    travels doubles. A round is staged, which also cuts the lineage; only a count reaches the driver. The edges must not
    give one node very many neighbours (callers use stars of bounded size).
    """
    both = stage(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        lower = stage(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "labels")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = stage(lower.join(up, "root").select("node", "was", F.col("above").alias("root")), "labels")
        if labels.where("root <> was").limit(1).count() == 0:
            return labels.select("node", "root")
        labels = labels.select("node", "root")
