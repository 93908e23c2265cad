"""Connected components by large-star and small-star steps, each a few shuffles of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b). Edges are written at each step; nothing but four numbers reaches the driver."""
    cur = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.write(hung.where("u != v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        for x in (cur, least, large, small_least):
            scratch.drop(x)
        now = step.agg(F.count("*"), F.sum(F.col("v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        cur = step
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return scratch.write(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
