"""Connected components in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable by edges (a, b), for every node that has
    one. Labels spread to neighbours and are then replaced by their own labels, so the
    rounds follow the logarithm of a component's width. Each round is written to the
    shared folder; the driver sees only whether labels changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = materialize(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        seen = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step, "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(step.join(up, "label").select("node", "old", F.least("label", "root").alias("label")), "labels")
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def join_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, label) after more edges (a, b): only those between different
    labels are looked at, as edges between labels. A node without a label is its own."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    e = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    e = materialize(e.where(F.col("a") != F.col("b")).distinct(), "edges")
    if not e.limit(1).count():
        return labels
    roots = connected_components(e)
    up = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return materialize(old.unionByName(roots.join(labels.select("node"), "node", "left_anti")), "labels")
