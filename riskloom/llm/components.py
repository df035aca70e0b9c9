"""Connected components by contraction: hook each root to its smallest neighbour, jump to the roots, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def _jumped(parents: DataFrame) -> DataFrame:
    """``(node, root)``: pointers followed to their ends, twice as far each time."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = parents.join(up, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        step = materialize(step)
        parents = step.select("node", "root")
        if not step.filter("moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge ``(a, b)``; the root is the smallest node of its component.

    Self edges are ignored.  Only aggregations meet on a node, so a hub's edges are combined before the shuffle; what
    is left shrinks each round.
    """
    left = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    labels = None
    while left.limit(1).count():
        parents = left.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        roots = _jumped(materialize(parents))
        a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab")
        moved = left.join(a, "a", "left").join(b, "b", "left")
        moved = moved.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        left = materialize(
            moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            older = labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            labels = materialize(older.union(roots.join(labels, "node", "left_anti")))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.union(labels.select(F.col("root").alias("node"), "root").distinct())
