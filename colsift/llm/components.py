"""Connected components of a link table, without any node's links meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsift.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component): the least node reachable, for every node with a link.

    Stars are folded until nothing moves: each node's neighbours are hung on the least of them, first those above it, then those
    below it. Minima are partial aggregates and the joins can be split, so a node with a third of all links is no hot spot. The
    rounds grow with the logarithm of the longest path; each writes its links to the shared folder.
    """
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        edges = (hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(edges, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return staged(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
