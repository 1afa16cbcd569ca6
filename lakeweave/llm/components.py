"""Connected components by contraction, as DataFrame joins.

In each round every node points to the smallest node next to it or to itself,
pointers are followed once more, and the edges between what they point to go to the
next round. Edges shrink geometrically, the number of rounds grows with the
logarithm of a component's width, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of ``edges`` (a, b)."""
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges", edges.count())
    roots, nodes = None, 0
    while most := edges.count():
        nodes = nodes or 2 * most
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "lowest", 2 * most)
        step = lowest.join(lowest.select(F.col("node").alias("_node"), F.col("up").alias("_up")), F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"))
        step = materialize(step, "step", 2 * most)
        if roots is None:
            roots = step.withColumnRenamed("up", "root")
        else:
            roots = materialize(roots.join(step, F.col("root") == step["node"], "left").select(roots["node"], F.coalesce("up", "root").alias("root")), "roots", nodes)
        a, b = (step.select(F.col("node").alias(f"_{x}"), F.col("up").alias(f"up_{x}")) for x in "ab")
        moved = edges.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
        edges = materialize(moved.filter("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges", most)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
