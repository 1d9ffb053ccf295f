"""Operator 11: hard negatives by vantage-point trees over norm-augmented vectors.

A row x of a tree gets one more component, sqrt(M^2 - |x|^2) with M the largest norm in the tree, and an anchor a gets
zero there. All rows then have length M, and |a - x|^2 = |a|^2 + M^2 - 2 a.x: an inner product between two bounds is a
distance in an annulus, and higher scores are nearer. Anchors and rows meet in a grid, anchors in groups and rows in
slices, one task for each pair; a task builds a vantage-point tree of its slice (halves by rank of distance, so copies
never make it deep) and walks it for all anchors at once, nearest leaf first: each anchor's leaves are in the order of the
least distance that the vantage points on their paths allow, leaves outside the annulus are left out, and an anchor stops
when its next leaf is farther than its k-th best row. Scores are exact whole numbers; distances only order and prune, with
room for their rounding. The slices' best k are merged by anchor.

This runs twice: for the best rows of an anchor's own label (its positives), all distances allowed; and, with a window of
scores from each positive, for rows of other labels.

Rows without id or label, and vectors that are null, empty or hold null or non-finite components, take no part. Shorter
vectors count as padded with zeros. Ties go to the smaller id. Rows with equal ids are different rows: an anchor row leaves
out one row that equals it (itself), and each anchor row has its own result; equal anchor rows are searched once and given
as often as they stand in the table. A positive whose score is negative has an empty window, one of score 0 the window 0.
Fewer positives or negatives than asked for: all. Empty tables give empty results. Only id, vector and label are read, so
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, shuffle_partitions
from .vectors import LEAST, MOST, inner, matrix, scaled, usable, width_of

ANCHOR_GROUP = 4096
"""Anchors of a task: each row is sent once for each group of them."""
SLICE_ROWS, LEAST_ROWS = 8192, 1024
"""Rows of a tree; fewer, down to the least, where there would be fewer tasks than shuffle partitions."""
LEAF = 64
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
"""A negative's score lies between these hundredths of the positive's."""


class Tree:
    """Vantage-point tree over the rows of x. Inner nodes are numbered as in a heap, and so are leaves."""

    def __init__(self, x: np.ndarray):
        self.x = x
        square = (x * x).sum(axis=1)
        self.square = float(square.max(initial=0))
        y = np.concatenate([x, np.sqrt(np.maximum(0.0, self.square - square))[:, None]], axis=1)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        inner_nodes = 2**self.depth - 1
        self.vantage = np.zeros((inner_nodes, x.shape[1]))
        self.least, self.most = np.zeros((inner_nodes, 2)), np.zeros((inner_nodes, 2))
        parts = [np.arange(len(x))]
        for level in range(self.depth):
            halves = []
            for k, rows in enumerate(parts):
                node = 2**level - 1 + k
                seen = y[rows]
                far = ((seen - seen.mean(axis=0)) ** 2).sum(axis=1)
                v = seen[far.argmax()]  # a row at the rim divides the others best
                d = np.sqrt(((seen - v) ** 2).sum(axis=1))
                order = np.argsort(d, kind="stable")
                half = (len(rows) + 1) // 2
                self.vantage[node] = v[:-1]
                for side, at in enumerate((order[:half], order[half:])):
                    self.least[node, side], self.most[node, side] = d[at].min(), d[at].max()
                    halves.append(rows[at])
            parts = halves
        self.leaves = parts

    def bounds(self, a: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each anchor to the rows of each leaf. An anchor has 0 where a vantage point has
        its added component, so their inner product is that of the plain vectors."""
        low, high = np.zeros((len(a), 1)), np.full((len(a), 1), np.inf)
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            d = np.sqrt(np.maximum(0.0, square[:, None] + self.square - 2 * (a @ self.vantage[nodes].T)))[:, :, None]
            near = np.maximum(self.least[nodes] - d, d - self.most[nodes])
            low = np.maximum(low[:, :, None], near).reshape(len(a), -1)
            high = np.minimum(high[:, :, None], d + self.most[nodes]).reshape(len(a), -1)
        return low, high


def itself(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray) -> np.ndarray:
    """The row that each anchor is, or -1 where it is in another slice; rows of one id are in one slice."""
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], a_ids, side=side) for side in ("left", "right"))
    own = np.full(len(a), -1)
    for i in np.flatnonzero(hi > lo).tolist():
        rows = order[lo[i] : hi[i]]
        same = np.flatnonzero((labels[rows] == a_labels[i]) & (x[rows] == a[i]).all(axis=1))
        own[i] = rows[same[0]] if len(same) else -1
    return own


def first_k(tree: Tree, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """(anchor row, id, score) of the k best rows of the same label, or of others, with scores from low to high.

    Best are high scores, then small ids. With `same` one row that is the anchor itself is left out."""
    n = len(a)
    square = (a * a).sum(axis=1)
    scale = square + tree.square
    room = np.sqrt(scale * a.shape[1] * 2.0**-49) + 1e-9  # a distance from rounded squares is off by this at most
    distance = lambda s, of=slice(None): np.sqrt(np.maximum(0.0, scale[of] - 2.0 * s.astype(float)))
    rim, hole = distance(low) + room, distance(high) - room
    best, best_id = np.full((n, k), LEAST), np.full((n, k), MOST)
    have = np.zeros(n, dtype=np.int64)
    own = itself(tree.x, ids, labels, a, a_ids, a_labels) if same else None
    near, far = tree.bounds(a, square)
    near = np.where((near <= rim[:, None]) & (far >= hole[:, None]) & (low <= high)[:, None], near, np.inf)
    order = np.argsort(near, axis=1, kind="stable")
    active = np.arange(n)
    for turn in range(len(tree.leaves)):
        leaf = order[active, turn]
        ahead = near[active, leaf]
        # the k-th best bounds what may still come; equal scores may have smaller ids
        going = np.isfinite(ahead) & ((have[active] < k) | (ahead <= distance(best[active, k - 1], active) + room[active]))
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        for q in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            rows = tree.leaves[order[q[0], turn]]
            s = inner(a[q], tree.x[rows])
            ok = (labels[rows][None] == a_labels[q][:, None]) == same
            if same:
                ok &= rows[None] != own[q][:, None]
            ok &= (s >= low[q][:, None]) & (s <= high[q][:, None])
            ok &= (s > best[q, k - 1][:, None]) | ((s == best[q, k - 1][:, None]) & (ids[rows][None] < best_id[q, k - 1][:, None])) | (have[q] < k)[:, None]
            some = np.flatnonzero(ok.any(axis=1))
            if not len(some):
                continue
            q, ok, s = q[some], ok[some], s[some]
            all_s = np.concatenate([best[q], np.where(ok, s, LEAST)], axis=1)
            all_id = np.concatenate([best_id[q], np.where(ok, ids[rows][None], MOST)], axis=1)
            by = np.lexsort((all_id, -1 - all_s), axis=1)[:, :k]  # -1 - s: the least number has no negative
            best[q], best_id[q] = np.take_along_axis(all_s, by, axis=1), np.take_along_axis(all_id, by, axis=1)
            have[q] = np.minimum(k, have[q] + ok.sum(axis=1))
    row, at = np.nonzero(np.arange(k)[None] < have[:, None])
    return row, best_id[row, at], best[row, at]


def _padded(*tables: pa.Table) -> list[np.ndarray]:
    width = width_of(*(t["v"] for t in tables))
    return [matrix(t["v"], width) for t in tables]


def positives(a: pa.Table, x: pa.Table, k: int) -> pa.Table:
    """The best rows of each anchor's label in a slice."""
    names = ("id", "turn", "other", "score")
    if not a.num_rows or not x.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    av, xv = _padded(a, x)
    ids, labels = a["id"].to_numpy(), a["label"].to_numpy()
    every = np.zeros(len(av), dtype=np.int64)
    row, other, score = first_k(Tree(xv), x["id"].to_numpy(), x["label"].to_numpy(), av, ids, labels, every + LEAST, every + MOST, True, k)
    return pa.table(dict(zip(names, (ids[row], a["turn"].to_numpy()[row], other, score), strict=True)))


def negatives(a: pa.Table, x: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The best rows of other labels in a slice for each anchor and positive, within the positive's window."""
    names = ("id", "turn", "place", "other", "score")
    if not a.num_rows or not x.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    av, xv = _padded(a, x)
    scores = a["scores"].to_pylist()
    anchor = np.repeat(np.arange(len(av)), [len(s) for s in scores])
    place = np.concatenate([np.arange(len(s)) for s in scores])
    flat = [v for s in scores for v in s]
    lo, hi = np.array([-((-low * v) // 100) for v in flat], dtype=np.int64), np.array([high * v // 100 for v in flat], dtype=np.int64)
    ids, labels = a["id"].to_numpy(), a["label"].to_numpy()
    row, other, score = first_k(Tree(xv), x["id"].to_numpy(), x["label"].to_numpy(), av[anchor], ids[anchor], labels[anchor], lo, hi, False, k)
    return pa.table(dict(zip(names, (ids[anchor[row]], a["turn"].to_numpy()[anchor[row]], place[row], other, score), strict=True)))


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, k_positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that satisfies `anchors` and
    each of its k_positives best rows of its label, the k best rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score."""
    rows = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull() & label.isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector)).alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    n, asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    groups = max(1, -(-asks // ANCHOR_GROUP))
    tasks = shuffle_partitions(vectors.sparkSession)
    slices = max(1, -(-n // SLICE_ROWS), min(-(-tasks // groups), n // LEAST_ROWS))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    grid = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    own = rows.where("asks").groupBy("id", "label", "v").agg(F.count("*").alias("times"))
    own = own.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy("label", "v")).cast("long"))
    own = own.toDF(*own.columns)  # columns of their own, apart from those of `rows`
    held = rows.select(grid(groups).alias("g"), deal("id", slices).alias("s"), "id", "label", "v").groupBy("g", "s")

    asked = own.select(deal("id", groups).alias("g"), grid(slices).alias("s"), "id", "label", "v", "turn")
    found = asked.groupBy("g", "s").cogroup(held).applyInArrow(lambda a, x: positives(a, x, k_positives), "id long, turn long, other long, score long")
    first = F.row_number().over(Window.partitionBy("id", "turn").orderBy(F.desc("score"), "other"))
    kept = found.withColumn("place", first - 1).where(F.col("place") < k_positives)
    pairs = cut(kept.groupBy("id", "turn").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("p")))  # at most k_positives a group

    asked = own.join(pairs, ["id", "turn"]).select(deal("id", groups).alias("g"), grid(slices).alias("s"), "id", "label", "v", "turn", F.col("p.score").alias("scores"))
    found = asked.groupBy("g", "s").cogroup(held).applyInArrow(lambda a, x: negatives(a, x, k, low, high), "id long, turn long, place long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("id", "turn", "place").orderBy(F.desc("score"), "other"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    told = best.join(pairs, ["id", "turn"]).join(own.select("id", "turn", "times"), ["id", "turn"]).withColumn("positive", F.get("p", F.col("place").cast("int")))
    told = told.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return told.select(F.col("id").alias("anchor_id"), F.col("positive.other").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: anchors are the rows whose vec_id is divisible by 100; of rows whose vec_id is divisible by 7, the label moves on."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, x.r AS xr, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.e, x.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.r <> x.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.r, p.place, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
