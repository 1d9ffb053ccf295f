"""Vector retrieval: ranking, best groups with a quota of views, recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.numeric import cosine, doubles, unit
from quoin.runtime import cut

GROUP, SLICE = 1024, 16_384
"""Queries and views of a cell of the grid of `recall`."""


def ranked(views: DataFrame, query: DataFrame, vector: str = "embedding", order: str = "vec_id", digits: int = 12) -> DataFrame:
    """views with cosine to the one row of `query` (column q, a unit vector) and view_rank; ties by `order`.

    Views are dealt to ranges of (cosine, order); a view's rank is its place in its range after the sizes of the ranges
    before it. Only these sizes, one a range, reach the driver."""
    scored = views.withColumn("unit", unit(doubles(F.col(vector)))).where("unit IS NOT NULL").crossJoin(F.broadcast(query))
    scored = scored.withColumn("cosine", F.round(cosine(F.col("unit"), F.col("q")), digits)).drop("unit", "q")
    keys = [F.desc("cosine"), F.asc(order)]
    spark = views.sparkSession
    dealt = cut(scored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    before = spark.createDataFrame([(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)], "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.join(F.broadcast(before), "_range").withColumn("view_rank", place + F.col("_before")).drop("_range", "_before")


def top_groups(views: DataFrame, query: DataFrame, group: str, groups: int, quota: int, vector: str = "embedding", order: str = "vec_id", digits: int = 12) -> DataFrame:
    """The first `groups` groups by their best view and at most `quota` views of each, without a global sort.

    Each group keeps its `quota` best; only these few rows of each group are ranked against each other."""
    scored = views.withColumn("unit", unit(doubles(F.col(vector)))).where("unit IS NOT NULL").crossJoin(F.broadcast(query))
    scored = scored.withColumn("cosine", F.round(cosine(F.col("unit"), F.col("q")), digits)).drop("unit", "q")
    own = Window.partitionBy(group).orderBy(F.desc("cosine"), order)
    kept = scored.withColumn("quota_rank", F.row_number().over(own)).where(F.col("quota_rank") <= quota)
    best = kept.where("quota_rank = 1").orderBy(F.desc("cosine"), order).limit(groups)
    best = best.select(group, F.row_number().over(Window.orderBy(F.desc("cosine"), order)).alias("group_rank"))
    return kept.join(F.broadcast(best), group)


def recall(queries: DataFrame, views: DataFrame, group: str, ks: tuple[int, ...], vector: str = "embedding", order: str = "vec_id", digits: int = 12) -> DataFrame:
    """(k, hits, n, recall): whether one of the k nearest other views has the query's group. `queries` is a stated set.

    Queries in groups and views in slices meet in a grid, a task for each pair of them: one matrix product, of which each
    query keeps its nearest. So what leaves a task grows with the queries, not with the pairs."""
    most = max(ks)
    u = lambda d: d.select(F.col(order).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), unit(doubles(F.col(vector))).alias("u")).where("u IS NOT NULL")
    groups, slices = (max(1, -(-d.count() // n)) for d, n in ((queries, GROUP), (views, SLICE)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = u(queries).select("*", deal(groups).alias("g")).select("*", every(slices).alias("s"))
    held = u(views).select("*", deal(slices).alias("s")).select("*", every(groups).alias("g"))

    def nearest(q: pa.Table, v: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and v.num_rows:
            a, b = (np.stack(t["u"].to_numpy(zero_copy_only=False)) for t in (q, v))
            ids, own = v["id"].to_numpy(), q["id"].to_numpy()
            for i in range(len(a)):
                c = np.round(np.clip(b @ a[i], -1.0, 1.0), digits)
                c[ids == own[i]] = -np.inf
                least = np.partition(c, -most)[-most] if len(c) > most else -np.inf
                near = np.flatnonzero((c >= least) & (c > -np.inf))
                near = near[np.lexsort((ids[near], -c[near]))][:most]
                rows.append((np.full(len(near), i), near, c[near]))
        at, other, c = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, int),) * 3
        return pa.table({"q_id": q["id"].take(pa.array(at)), "q_g": q["grp"].take(pa.array(at)), "v_id": v["id"].take(pa.array(other)), "v_g": v["grp"].take(pa.array(other)), "c": pa.array(c, pa.float64())})

    found = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(nearest, "q_id long, q_g string, v_id long, v_g string, c double")
    w = Window.partitionBy("q_id").orderBy(F.desc("c"), "v_id")
    near = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    first = near.groupBy("q_id").agg(F.min(F.when(F.col("q_g") == F.col("v_g"), F.col("r"))).alias("first"))
    each = first.select("first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return each.groupBy("k").agg(F.count_if(F.col("first") <= F.col("k")).alias("hits"), F.count("*").alias("n")).withColumn("recall", F.col("hits") / F.col("n"))


def query_vector(views: DataFrame, which: Column, vector: str = "embedding") -> DataFrame:
    """The unit vector of the view for which `which` holds; the least of several, so runs agree."""
    return views.where(which).agg(F.min(unit(doubles(F.col(vector)))).alias("q")).where("q IS NOT NULL")
