"""Connected components by alternating star operations, one aggregation and one join each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.plans.runtime import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them and itself."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("_a"))
    out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Edges with a null end or equal ends count for nothing.  Rounds go on until no edge changes, so there is no limit
    on the length of a chain; the number of rounds grows with its logarithm.
    """
    found = cut(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while not found.empty:
        large = _star(_both(found.df), True)
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        found = cut(_star(small, False))
        now = found.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = found.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
