"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the edges (a, b) reaches.

    Large-star hangs a node's larger neighbours under its smallest neighbour,
    small-star its smaller ones; in the end every node hangs under its component's
    smallest. Each round is written to the shared folder. Nodes without edges, and
    null ends, are not in the result; loops give their node alone.
    """
    edges = cut(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e, before = edges.where("a > b"), None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        down = e.join(low, "a")
        e = cut(down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m"))).where("a != b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            break
        before = now
    return nodes.join(e, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
