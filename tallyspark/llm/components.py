"""Connected components of a link table by randomised contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; roots are equal exactly within a component.

    Each round every node takes the name of the node of least hash within two links, under a hash
    that changes by the round. Linked nodes get linked or equal names, so components stay whole and
    apart, and the names shrink by a constant factor in expectation, whatever the graph's shape.
    Null ends and loops are ignored.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    steps: list[DataFrame] = []
    for turn in range(100):
        order = lambda c, k=turn: F.struct(F.xxhash64(F.lit(k), c), c.alias("id"))
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("best")).select("a", F.least(order(F.col("a")), F.col("best")).alias("best"))
        # Two steps at once: the least that a neighbour has found counts as well, so a star closes in one round.
        far = both.join(near.withColumnsRenamed({"a": "b"}).hint("shuffle_hash"), "b").groupBy("a").agg(F.min("best").alias("far"))
        steps.append(cut(far.select(F.col("a").alias("was"), F.col("far.id").alias("now"))))
        moved = lambda end: steps[-1].select(F.col("was").alias(end), F.col("now").alias(f"{end}_now")).hint("shuffle_hash")  # noqa: E731, B023
        edges = edges.join(moved("a"), "a").join(moved("b"), "b").select(F.least("a_now", "b_now").alias("a"), F.greatest("a_now", "b_now").alias("b"))
        edges = cut(edges.where("a <> b").distinct())
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("contraction did not end")
    labels = steps[0].select(F.col("was").alias("node"), F.col("now").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step.hint("shuffle_hash"), labels.root == step.was, "left").select("node", F.coalesce("now", "root").alias("root"))
    return labels


def smallest_of(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node of each node's component."""
    labels = cut(components(links))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return cut(labels.join(least.hint("shuffle_hash"), "root").select("node", "component"))
