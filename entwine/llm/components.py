"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import cut


def components(links: DataFrame, one: str = "a", other: str = "b", most_rounds: int = 50) -> DataFrame:
    """node and root (the smallest node of its component) for every node that is in a link with another.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then all neighbours that are not larger;
    rounds grow with the logarithm of the longest path. Every step is a join or an aggregate, and rounds are cut in the shared folder. Links
    with null or of a node with itself are left out; repeated links count once.
    """
    edges = cut(links.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(lowest, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
