"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): alternating large-star and small-star rounds until the stars no
    longer change. Rounds grow with the logarithm of the longest path; every round reads and writes the shared folder."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        sym = both(now)
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        now = materialize(small, "edges")
        mine = mark(now)
        if mine == seen:
            break
        seen = mine
    stars = now.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
