"""Connected components of links held in a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): component is the smallest node reachable.

    Rounds of random-mate contraction: every node joins the closed neighbour with the smallest hash of the round, links are
    renamed, loops and repeats go, until no link is left. The number of links falls by a constant factor a round on average,
    so there are about as many rounds as the logarithm of their number; each round is joins and map-side combined minima."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    maps: list[DataFrame] = []
    left, turn = links, 0
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        key = [F.xxhash64(F.col(c), F.lit(turn)) for c in ("a", "b")]
        lowest = both.groupBy("a").agg(F.min(F.struct(key[1].alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(key[0].alias("h"), F.col("a").alias("to"))
        chosen = materialize(lowest.select(F.col("a").alias("from"), F.least("m", own)["to"].alias("to")), "link-targets")
        maps.append(chosen)
        left = left.join(chosen.withColumnRenamed("from", "a"), "a").select(F.col("to").alias("a"), "b")
        left = left.join(chosen.withColumnRenamed("from", "b"), "b").select("a", F.col("to").alias("b"))
        left = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        turn += 1
    named = nodes.withColumn("root", F.col("node"))
    for chosen in maps:
        named = named.join(chosen.withColumnRenamed("from", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    named = materialize(named, "link-roots")
    smallest = named.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(named.join(smallest, "root").select("node", "component"), "components")
