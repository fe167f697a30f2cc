"""Connected components of a large edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; no component is gathered anywhere. The number of
steps grows with the logarithm of the longest chain. Edges are stored between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `root` for every node with an edge; the root is the component's least node."""
    now = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        # Large star: each larger neighbour of u is tied to the least of u and its neighbours.
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select(
            "c", F.least("c", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c")).where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(low.select(F.col("c"), F.col("m"))).distinct(), "edges")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            # Stable: every edge leads from a node straight to its root.
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        mark = after
