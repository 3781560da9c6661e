"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the smallest node of its component.

    Every round hooks each label to the smallest label next to it and halves the paths; rounds grow with the logarithm
    of a component's width. Nothing but a count goes to the driver; each round is checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("next")), "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("least"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "least").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = cut(hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("changed")))
        labels = moved.select("node", "label")
        release(edges.sparkSession)
        if moved.where("changed").isEmpty():
            return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels after more edges (a, b): the edges join whole components, so only a graph of labels is searched."""
    name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = cut(more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    moved = components(ends).select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    # members that had no link before are labels of their own
    fresh = moved.join(labels, moved["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("new").alias("label"))
    return old.union(fresh)
