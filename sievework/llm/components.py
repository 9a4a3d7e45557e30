"""Connected components of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b) that is not the smallest of its own component.

    The links stay distributed; each round, a logarithmic number of them, is written to the checkpoint folder. Neighbours'
    minima come from partial aggregates, so a node with very many links spreads over tasks.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state or not now["n"]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        state = (now["n"], now["h"])
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        lows = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lows, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        edges = cut(small.where("v <> u").distinct())
