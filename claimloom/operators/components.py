"""Connected components by alternating large-star and small-star steps.

A step sends each node's neighbours to the smallest of them, so a component becomes a
star after O(log n) rounds.  Neighbour lists are never gathered: the minimum comes from
a combining aggregation and reaches the edges by a join, so a node with a third of all
edges stays spread over tasks.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.runtime import drop_path, stage_path, staged


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every end of an edge; the component is its smallest node.

    Null ends and loops make no edge; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    root = stage_path(spark, "components")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    e = staged(e, "edges", f"{root}/0")
    r, before = 0, None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        r += 1
        nxt = staged(small, "edges", f"{root}/{r}")
        state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, f"{root}/{r - 1}")
        e = nxt
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
