"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node of ``edges`` (a, b): the smallest node that is reachable.

    Labels spread to neighbours' smallest label and then jump to their label's label, so the rounds grow with the
    logarithm of a component's width, not with the width. Each round is written, the last one is read back.
    """
    links = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = step.join(far, "component", "left").select("node", F.least("component", "far").alias("component"), "was")
        step = written(step, "labels")
        moved = step.where("component <> was").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels
