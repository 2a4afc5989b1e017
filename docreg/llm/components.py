"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component): the smallest node reachable.

    Minimum labels travel along the links and then jump to the label of the label, so a
    chain of n links takes about log n rounds. Each round is checkpointed; only the number
    of changed labels reaches the driver. Nodes without links do not appear.
    """
    links = links.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    both = settle(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        moved = settle(labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")))
        target = moved.select(F.col("node").alias("at"), F.col("component").alias("there"))
        jumped = settle(moved.join(target, F.col("component") == F.col("at")).select(
            "node", F.least("component", "there").alias("component"), "before"))
        changed = jumped.where(F.col("component") != F.col("before")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
