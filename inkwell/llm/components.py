"""Connected components by alternating stars, in DataFrame operations.

A large star hangs each node's larger neighbours on the least node near it, a small star its smaller ones; by turns they
reach one star per component in a number of rounds that grows with the logarithm of the nodes. Only least neighbours are
aggregated, and edges meet them in joins that split a hub's rows, so no task holds the neighbours of a node. Every round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node reachable. Null ends and loops are no edges."""
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = cut(edges.where("a <> b").select(big, small).distinct())
    while True:
        near = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        if _done(stars):
            break
    hubs = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(hubs))


def _done(stars: DataFrame) -> bool:
    """Whether every node hangs on one hub that hangs on none."""
    counted = stars.groupBy("u").agg(F.count("v").alias("n"), F.lit(0).alias("hub")).unionAll(stars.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("hub")).distinct())
    return counted.groupBy("u").agg(F.sum("n").alias("n"), F.sum("hub").alias("hub")).where("n > 1 or (n > 0 and hub > 0)").limit(1).count() == 0
