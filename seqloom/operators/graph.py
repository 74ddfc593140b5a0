"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import cut


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's connected component, for all nodes with a link. links: a, b.

    Alternating large-star and small-star steps: the edges stay in the cluster, every step is a
    join with a pre-aggregated minimum, and the number of rounds grows with the logarithm of the
    longest chain. Loops and repeated links do no harm; no links give an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, bare=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), bare=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small, bare=True)
        # Equal counts and nothing new: the stars stand.
        same = small.count() == edges.count() and edges.join(small, ["u", "v"], "left_anti").limit(1).count() == 0
        edges = small
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
