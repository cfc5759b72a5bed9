"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, write_shared


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): label is the smallest id reachable.

    Every round takes the smallest label among neighbours and then the label of that label (pointer
    jumping), so that rounds grow with the logarithm of a chain's length. Each round is written to the
    shared folder; nothing but a count of changes reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_shared(both.filter("a <> b").distinct(), "edges")
    labels = write_shared(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    held = labels
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = near.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("next"), "label")
        new = write_shared(new, "labels")
        discard(held)
        if new.filter("next <> label").isEmpty():
            discard(both)
            return new.select("id", "label")
        held, labels = new, new.select("id", F.col("next").alias("label"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (id, label) after more edges (a, b): the components of what the edges join are merged, whatever their size."""
    own = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    ends = edges.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    between = ends.select(F.coalesce("l_a", "a").alias("x"), F.coalesce("l_b", "b").alias("y")).filter("x <> y")
    between = write_shared(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "between")
    if between.isEmpty():
        return labels
    up = components(between)
    moved = labels.join(up.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return write_shared(moved.unionByName(up.join(labels.select("id"), "id", "left_anti")), "labels")
