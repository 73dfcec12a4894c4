"""Connected components of an edge list, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.sizing import written_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node of its component.

    Each round takes the smallest label around a node and then the label of that
    label, so that long chains shrink by doubling. Labels are written between
    rounds; the loop ends when none changes. Only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = written_table(both.union(edges.select("b", "a")).where("node <> near").distinct())
    labels = written_table(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("seen"))
        lower = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = lower.join(jump, "root").select("node", "old", F.least("root", "further").alias("root"))
        after = written_table(after)
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
