"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitweave.session import materialize

HOPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (a, b: long): the nodes of a component share their root.

    Each round points every node at its smallest neighbour, follows ``HOPS`` pointers more, and contracts the
    edges to those between different roots.  A round leaves at most half of the linked nodes, and of a
    path a quarter, so rounds grow with the logarithm of the longest chain.  Rounds are written.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "graph-edges")
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        pointer = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("root"))
        pointer = materialize(pointer, "graph-pointers")
        jumped = pointer
        for _ in range(HOPS):
            step = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = jumped.join(step, "root").select("node", F.col("next").alias("root"))
        pointer = materialize(jumped, "graph-jumped")
        step = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if labels is None:
            labels = pointer
        else:
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "graph-labels")
        for end in ("a", "b"):
            edges = edges.join(pointer.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end).drop(end)
        edges = edges.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = materialize(edges, "graph-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
