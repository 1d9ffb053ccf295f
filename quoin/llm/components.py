"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two group-bys over distinct edges and ends in a reliable checkpoint; only counts reach the driver. A hub
is split: the minimum of its neighbours is a partial aggregate, and edges join it by key, which AQE can divide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge other than its own root; root is the smallest node reachable."""
    e = cut(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct())
    release(edges.sparkSession)  # what made the edges may be large
    last = None
    for _ in range(rounds):
        both = e.union(e.select("hi", "lo").toDF("lo", "hi")).toDF("v", "n")
        least = both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("m"))
        large = both.where("n > v").join(least, "v").select(F.col("m").alias("lo"), F.col("n").alias("hi")).where("lo < hi").distinct()
        # small-star: every node points down; its lower neighbours and itself go to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo < hi").distinct()
        e = cut(small)
        n, s, uneven = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.count_distinct("hi")).first()
        if (n, s) == last and n == uneven:
            break
        last = (n, s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
