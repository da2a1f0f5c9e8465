"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node; written first, so that the join can split a hub's edges."""
    return common.materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, for each node with an edge.

    Only counts and check sums come to the driver. A hub's edges are pre-aggregated in each task and
    split in the joins. No edges: no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = common.materialise(edges, "edges")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = common.materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        common.discard(edges)
        down = _least(large)
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = common.materialise(small.distinct(), "edges")
        for spent in (least, large, down):
            common.discard(spent)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
