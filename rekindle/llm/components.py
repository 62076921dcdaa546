"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.llm.store import cut


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Larger neighbours (both) or smaller ones and the node itself are tied to a node's smallest neighbour."""
    near = edges.select("a", "b")
    if both:
        near = near.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if both:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the label is the component's smallest node.

    Large and small stars take turns until the edges stay the same, each round cut off by a checkpoint. Minima are combined
    before the shuffle and joins split large nodes, so a node may be linked to most others. The driver sees one count and one sum a round.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum_of(edges)
    while True:
        edges = cut(_star(_star(edges, both=True), both=False))
        now = _sum_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
