"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two group-and-join steps over the links that are left; no node's links meet in one task (minima are
summed before the shuffle, and the joins are with one row per node, so a hot node's links can be split). The
number of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import discard, stash

ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest node.

    Null ends and loops are ignored; repeated links count once; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = stash(edges.distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = stash(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stash(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small")
        seen = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (edges, least, large, lowest):
            discard(old)
        edges = small
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
