"""Connected components of an edge table, by label minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so a path shrinks by more than half a round. Rounds are written to
    the shared folder; only one count a round reaches the driver. A node with many
    neighbours meets them in a partial minimum before the shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        fresh = written(near.join(far, "component", "left").select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component")), "cc-labels")
        forget(labels)
        labels = fresh
        if not labels.filter("component < old").limit(1).count():
            forget(both)
            return labels.select("node", "component")
