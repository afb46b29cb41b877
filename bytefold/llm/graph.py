"""Connected components of a link table by alternating large-star and small-star joins.

Stars keep the number of links at or below its start, nothing is collected but one
checksum a round, and each round's links are a written table. The smallest neighbours
are broadcast while the links are few enough to bound their number, so the links of a hub
stay where they are; beyond that they are written and joined by a shuffle of two plain
tables, in which Spark splits a hub's links over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefold.llm import workspace


FEW = 500_000


def _state(edges: DataFrame) -> tuple:
    x = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.bit_xor(F.xxhash64(x)).alias("y")).first()
    return row["n"], row["x"], row["y"]


def components(links: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b: long), root the smallest node reachable.

    Self-links, repeats and nulls are ignored; a node without a link to another has no row. Raises
    if it has not settled after `rounds` rounds (the number needed grows as the log of the nodes).
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = workspace.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a node has a row at most, and so many links have twice as many nodes at most
        lookup = F.broadcast if before[0] <= few else lambda x: workspace.keep(x, "low")
        low = lookup(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = lookup(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = workspace.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        workspace.drop(low, least)
        workspace.drop(edges)
        edges, was, before = after, before, _state(after)
        if was == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
