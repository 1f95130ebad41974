"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.staging import discard, stage


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long. Returns node, root (the smallest node reachable) of every node that has a link.

    Only minima per node are aggregated and links joined on their nodes, so a node
    with very many links is no group that one task must hold. Each round is written
    to the shared folder. Self-links and repeats are ignored; no links: no rows.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # Large star: the larger neighbours of each node go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of each node, and it, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stage(small.distinct(), "links")
        discard(edges)
        # Done when every link is the only one of its upper node, and no lower node is an upper one.
        uppers = new.select("u")
        many = new.groupBy("u").count().where("count > 1").isEmpty()
        if many and new.join(uppers.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            roots = new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges = new
