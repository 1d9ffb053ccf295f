"""Operator 9: exact top-k by inner product with columnar branch-and-bound.

Queries and candidates meet in a grid: queries in groups, candidates in slices, one task for each pair of them, so
neither side is ever held whole. In a task the candidates lie dimension by dimension. Scores grow one block of
dimensions at a time; after each, a candidate stays only while its partial score plus the product of the norms that
are left (Cauchy-Schwarz) reaches the k-th best score known for the query, with room for what both are rounded by;
survivors are compacted, and the last of them are scored in whole numbers. The slices' best k are merged by query.

Vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; ties go to the smaller id; scores beyond 64 bits stand at the ends of that range. Rows with equal ids are different rows: a query's candidates are all rows but its own one,
and each query row gets its own k best (equal rows are scored once and given as often as they stand in the table). Fewer
than k candidates: all. Empty tables give empty results. Only the id and the vector are read, so other columns, whatever
their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions
from .vectors import inner, matrix, scaled, usable, width_of

QUERY_GROUP = 4096
"""Queries of a task: each candidate is sent once for each group of them."""
SLICE_ROWS = 16_384
LEAST_ROWS = 512
"""Slices are made smaller, down to this, where there would be fewer tasks than shuffle partitions."""
BLOCK = 8


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best candidates of each query; rows of ids and x in any order."""
    width = x.shape[1]
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(x[order].T)  # vertical layout
    cuts = [*range(0, width, BLOCK), width]
    left_x = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1])  # norm of dimensions d and on
    out_q, out_id, out_s = [], [], []
    most = left_x[0].max(initial=0) if width else 0.0
    every = np.arange(len(ids))

    def own(i: int) -> np.ndarray:
        """The query's own row, if it lies in this slice: one of the rows with its id and its vector."""
        lo, hi = np.searchsorted(ids, q_ids[i]), np.searchsorted(ids, q_ids[i], side="right")
        return lo + np.flatnonzero((columns[:, lo:hi] == q[i][:, None]).all(axis=0))[:1]

    for i in range(len(q)):
        v = q[i]
        alive = np.delete(every, own(i))
        part = np.zeros(len(alive))
        spread = np.argsort(-np.abs(v), kind="stable")[:BLOCK]
        if len(alive) > 8 * k:  # a first bound: full scores of the candidates that look best in the largest dimensions
            seed = alive[np.argpartition(-(v[spread] @ columns[spread][:, alive]), 4 * k)[: 4 * k]]
            floor_ = np.partition(v @ columns[:, seed], -k)[-k]
        else:
            floor_ = -np.inf
        left_v = np.sqrt(np.cumsum((v**2)[::-1])[::-1])
        slack = left_v[0] * most * (width + 8) * 2.0**-50 + 1e-6  # what rounded sums of such products can be off by
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part += v[lo:hi] @ columns[lo:hi, alive] if len(alive) < len(ids) - 1 else (v[lo:hi] @ columns[lo:hi])[alive]
            if hi < width and len(alive) > k:
                rest = left_v[hi] * left_x[hi, alive]
                stay = part + rest * (1 + 1e-9) + slack >= floor_ - slack
                alive, part = alive[stay], part[stay]
        score = inner(v[None], np.ascontiguousarray(columns[:, alive].T))[0]
        top = np.lexsort((ids[alive], -1 - score))[:k]  # -1 - score: the least number has no negative
        out_q.append(np.full(len(top), i))
        out_id.append(ids[alive[top]])
        out_s.append(score[top])
    cat = lambda a: np.concatenate(a) if a else np.empty(0, np.int64)
    return cat(out_q), cat(out_id), cat(out_s)


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row that satisfies `queries`."""
    rows = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n, asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    groups = max(1, -(-asks // QUERY_GROUP))
    tasks = shuffle_partitions(vectors.sparkSession)
    slices = max(1, -(-n // SLICE_ROWS), min(-(-tasks // groups), n // LEAST_ROWS))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    grid = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    own = rows.where("asks").groupBy("id", "v").agg(F.count("*").alias("times"))
    own = own.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
    asked = own.select(deal("id", groups).alias("g"), grid(slices).alias("s"), "id", "v", "turn", "times")
    held = rows.select(grid(groups).alias("g"), deal("id", slices).alias("s"), "id", "v")

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "turn", "times", "vec_id", "score")})
        width = width_of(q["v"], x["v"])
        a, b, c = best(q["id"].to_numpy(), matrix(q["v"], width), x["id"].to_numpy(), matrix(x["v"], width), k)
        return pa.table({"query_id": q["id"].to_numpy()[a], "turn": q["turn"].to_numpy()[a], "times": q["times"].to_numpy()[a], "vec_id": b, "score": c})

    parts = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(run, "query_id long, turn long, times long, vec_id long, score long")
    w = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: queries are the rows whose vec_id is divisible by 50, candidates all others; the five best."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(v, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
