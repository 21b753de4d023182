"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long);
    component is the smallest node reachable.  Self-loops and repeated edges
    are allowed; nodes without an edge to another node are not returned.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014): every node
    hands its larger, then its smaller neighbours to its smallest neighbour,
    until the edges are stars.  Each round is a map-side combined minimum and
    one join on the node; a hub's edges are the large side of that join, which
    Spark can split.  Each round is written to the shared folder, so a lost
    executor repeats at most one round."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u <> v").distinct())
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.filter("v > u").join(low, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(small_low, "u")
        e = cut(j.select(F.col("u"), F.col("m").alias("v"))
                 .unionByName(j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
             .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
