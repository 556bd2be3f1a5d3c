"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): each node that has an edge, save
    the roots themselves, with the smallest node it can reach.

    A large star links a node's larger neighbours to its smallest, a small star
    its smaller ones; both keep components as they are, and the edges end as
    stars around the smallest node. Minima are aggregates with map-side
    combination, written before the join that uses them, so the edges of a hub
    are split over tasks by Spark's skew join. Nulls and loops are left out.
    """
    now = cut(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    was = None
    state = _state(now)
    while state != was:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        was, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
