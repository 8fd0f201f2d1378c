"""Connected components of an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a long, b long); label is the smallest node reachable.

    Each round takes the smallest label among neighbours and then follows labels once (pointer jumping), so long
    chains take a number of rounds near the logarithm of their length. Rounds are cut by tables in shared storage, and
    go on until no label changes. An edge of a node with itself, repeated edges and an empty table are fine.
    """
    proper = edges.filter(F.col("a") != F.col("b"))
    both = materialize(proper.select("a", "b").union(proper.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    changed = not labels.isEmpty()
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialize(lower.join(jump, "label").select("node", "before", F.col("further").alias("label")), "labels")
        release(lower, labels)
        labels = after
        changed = not labels.filter("label <> before").isEmpty()
    release(both)
    out = labels.select("node", "label")
    out._kindred_path = labels._kindred_path
    return out
