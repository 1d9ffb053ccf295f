"""Operator 8: embedding near-duplicates by dual traversal of cover trees.

Vectors are scaled to length one, so cosine >= t is a chord of at most sqrt(2 - 2t). Equal vectors of a label are one
class with a weight. Each label's classes are dealt to blocks of bounded size by nearest pivot (a top level of the
tree from a bounded sample; oversized cells are split by hash). Block pairs whose pivots are farther apart than their
covering radii and the chord allow are pruned; each other pair goes to a task of its own, which builds a cover tree of
nested levels with halving radii for either block and walks both at once, pruning node pairs by the same bound.
Leaf pairs are decided by the cosine in double precision; all bounds have room for rounding. A task returns counts of links for each vector and the edges
of a spanning forest of its links, not the pairs, so a large group of near copies stays linear.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or id, link with
nothing; vectors of different lengths never link. A cosine of exactly the threshold, as computed in doubles, links. Rows that share an id are one node, whose links add up; each
keeps its own row in the result. Empty tables give empty results. Only id, vector and label are read, so other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .vectors import usable

COSINE = 0.93
BLOCK_ROWS = 4096
PIVOTS = 64
LEAF = 64
ASSIGN_ROWS = 1 << 15
"""Vectors that one task compares with a label's pivots."""
SLACK = 1e-5
"""Chords that come from an inner product are off by up to the root of its rounding: less than this, in any dimension used."""
PLAIN = (1e-100, 1e100)
"""Largest components between these need no scaling."""


class Tree:
    """Cover tree over unit vectors: a node has a centre, a covering radius, and children or a few rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.root = 0
        todo = [(np.arange(len(x)), 2.0, -1)]
        while todo:
            todo += self._node(*todo.pop())

    def _node(self, rows: np.ndarray, span: float, parent: int) -> list[tuple[np.ndarray, float, int]]:
        """Adds a node and returns what its children are to be; each has at least one row and not all."""
        x = self.x[rows]
        d = apart(x, x[0])
        me = len(self.centre)
        self.centre.append(x[0])
        self.radius.append(float(d.max()))
        self.children.append([])
        self.rows.append(rows)
        if parent >= 0:
            self.children[parent].append(me)
        span = min(span, self.radius[me])
        if len(rows) <= LEAF or not span:
            return []
        # the next level: centres more than half the radius apart, each row with its nearest centre
        half, centres, nearest, owner = span / 2, [0], d.copy(), np.zeros(len(rows), dtype=np.int64)
        while nearest.max() > half and len(centres) < 64:
            far = int(nearest.argmax())
            new = apart(x, x[far])
            closer = new < nearest
            closer[far] = True
            owner[closer], nearest = len(centres), np.minimum(nearest, new)
            centres.append(far)
        out = []
        for k, centre in enumerate(centres):
            mine = np.flatnonzero(owner == k)
            if len(centres) > 1 and len(mine):
                out.append((rows[np.r_[centre, mine[mine != centre]]], half if len(centres) < 64 else span, me))
        return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords from rows to one point, from their differences: right also where they are tiny."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords of all pairs of rows, within SLACK."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual(a: Tree, b: Tree, same: bool, limit: float):
    """Pairs (rows of a, rows of b) of leaf size that may hold links; each unordered pair of nodes once if same."""
    todo = [(a.root, b.root)]
    while todo:
        i, j = todo.pop()
        if same and i == j:
            kids = a.children[i]
            if not kids:
                yield a.rows[i], b.rows[j]
            todo += [(p, q) for n, p in enumerate(kids) for q in kids[n:]]
            continue
        if apart(a.centre[i], b.centre[j]) > a.radius[i] + b.radius[j] + limit:
            continue
        left, right = a.children[i], b.children[j]
        if not left and not right:
            yield a.rows[i], b.rows[j]
        elif left and (not right or a.radius[i] >= b.radius[j]):
            todo += [(p, j) for p in left]
        else:
            todo += [(i, q) for q in right]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def links(ids_a, raw_a, w_a, ids_b, raw_b, w_b, same: bool, cosine: float):
    """Weighted links of each vector and the edges of a spanning forest of one block pair."""
    norm_a, norm_b = np.sqrt((raw_a**2).sum(axis=1)), np.sqrt((raw_b**2).sum(axis=1))
    unit_a, unit_b = raw_a / norm_a[:, None], raw_b / norm_b[:, None]
    tree_a = Tree(unit_a)
    tree_b = tree_a if same else Tree(unit_b)
    n_a, n_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    forest = Forest(len(ids_a) + (0 if same else len(ids_b)))
    shift = 0 if same else len(ids_a)
    for p, q in dual(tree_a, tree_b, same, np.sqrt(2 - 2 * cosine) + SLACK):
        near = (raw_a[p] @ raw_b[q].T) / (norm_a[p][:, None] * norm_b[q][None]) >= cosine
        own = same and len(p) == len(q) and (p == q).all()
        if own:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        n_a[p] += near @ w_b[q]
        if not own:
            n_b[q] += near.T @ w_a[p]
        r, c = np.nonzero(near)
        # of a full block of links, each row with the first column and each column with the first row are enough
        if near.all():
            r, c = np.r_[np.arange(len(p)), np.zeros(len(q), dtype=int)], np.r_[np.zeros(len(p), dtype=int), np.arange(len(q))]
        for i, j in zip(p[r].tolist(), (q[c] + shift).tolist(), strict=True):
            forest.join(i, j)
    if same:
        n_a = n_a + n_b
    return n_a, n_b, forest.edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    most = F.array_max(F.transform("v", F.abs))  # where squares would leave the range of doubles, only the direction counts
    v = F.when(most.between(*PLAIN) | (most == 0), F.col("v")).otherwise(F.transform("v", lambda x: x / most))
    good = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("ok", F.col("ok") & F.coalesce(F.when(F.col("ok"), most > 0), F.lit(False)))
    keyed = keyed.withColumn("v", F.when(F.col("ok"), v).otherwise(F.col("v")))
    # label and size make the key: vectors of different sizes never meet
    classes = cut(
        keyed.where("ok").select(F.concat_ws("/", F.size("v").cast("string"), "label").alias("k"), "v", "vec_id")
        .groupBy("k", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    )
    sizes = classes.groupBy("k").agg(F.count("*").alias("n"))
    # top level: about two pivots for each block a label needs, PIVOTS at most, the first of a sample in the order of a hash
    wanted = F.expr(f"CAST(least({PIVOTS}, ceil(2 * n / {block_rows})) AS INT)")
    top = (
        classes.join(sizes.where(F.col("n") > block_rows), "k")
        .where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.greatest(F.lit(1), F.expr(f"n div {4 * PIVOTS}"))) == 0)
        .select("k", "n", F.struct(F.xxhash64("id").alias("h"), "v").alias("p")).groupBy("k", "n").agg(F.sort_array(F.collect_list("p")).alias("ps"))
        .select("k", F.slice("ps", 1, wanted).alias("ps")).select("k", F.col("ps.v").alias("pivots"))
    )

    def assign(table: pa.Table, pivots: pa.Table) -> pa.Table:
        cell, far = np.zeros(table.num_rows, dtype=np.int64), np.full(table.num_rows, 2.0)
        if table.num_rows and pivots.num_rows:
            p = np.array(pivots["pivots"].to_pylist()[0], dtype=float)
            p /= np.sqrt((p**2).sum(axis=1))[:, None]
            x = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            d = chord(x / np.sqrt((x**2).sum(axis=1))[:, None], p)
            cell, far = d.argmin(axis=1), d.min(axis=1)
        return pa.table({"k": table["k"], "v": table["v"], "id": table["id"], "w": table["w"], "cell": pa.array(cell), "far": pa.array(far)})

    # a label's classes are dealt to groups of bounded size, to each of which its pivots go
    deals = sizes.select("k", F.ceil(F.col("n") / ASSIGN_ROWS).cast("int").alias("deals"))
    pivoted = top.join(deals, "k").select(F.col("k").alias("pk"), F.col("pivots"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("ps"))
    dealt_out = classes.join(deals, "k").withColumn("s", F.pmod(F.xxhash64("id"), "deals").cast("int")).drop("deals")
    cells = cut(dealt_out.groupBy("k", "s").cogroup(pivoted.groupBy("pk", "ps")).applyInArrow(lambda t, p: assign(t, p), "k string, v array<double>, id long, w long, cell long, far double"))
    parts = cells.groupBy("k", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
    blocks = parts.select("k", "cell", "r", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).alias("m"))
    dealt = cells.join(blocks.select("k", "cell", "m"), ["k", "cell"]).select("k", F.concat_ws("/", F.col("cell").cast("string"), F.pmod(F.xxhash64("id"), "m").cast("string")).alias("block"), "v", "id", "w")
    listed = blocks.join(top, "k", "left").select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("part"), "cell", "r", F.get("pivots", F.col("cell").cast("int")).alias("p"))
    listed = listed.select("k", F.concat_ws("/", F.col("cell").cast("string"), F.col("part").cast("string")).alias("block"), "r", "p")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = lambda c, d: F.aggregate(F.zip_with(c, d, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    between = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot("a.p", "b.p") / (norm("a.p") * norm("b.p"))))
    pairs = listed.alias("a").join(listed.alias("b"), F.expr("a.k = b.k AND a.block <= b.block"))
    pairs = pairs.where((F.col("a.block") == F.col("b.block")) | F.col("a.p").isNull() | (between <= F.col("a.r") + F.col("b.r") + float(np.sqrt(2 - 2 * cosine)) + SLACK))
    pairs = cut(pairs.select(F.col("a.k").alias("k"), F.col("a.block").alias("x"), F.col("b.block").alias("y")))
    sides = pairs.select("k", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    sent = sides.join(dealt, ["k", "block"]).select("k", "x", "y", "side", "id", "w", "v")

    def run(table: pa.Table) -> pa.Table:
        side, ids, w = table["side"].to_numpy(), table["id"].to_numpy(), table["w"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b) and table["x"][0].as_py() == table["y"][0].as_py()
        if not len(a) or not (same or len(b)):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        b = a if same else b
        n_a, n_b, edges = links(ids[a], x[a], w[a], ids[b], x[b], w[b], same, cosine)
        every = np.r_[ids[a], ids[b]] if not same else ids[a]
        count = np.r_[n_a, n_b] if not same else n_a
        some = np.flatnonzero(count)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pa.table({"id": np.r_[every[some], every[e[:, 0]]], "n": np.r_[count[some], np.zeros(len(e), np.int64)], "other": np.r_[every[some], every[e[:, 1]]]})

    found = cut(sent.groupBy("k", "x", "y").applyInArrow(run, "id long, n long, other long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("id <> other"), "id", "other")
    by_class = classes.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").select("k", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    key = F.when(F.col("ok"), F.concat_ws("/", F.size("v").cast("string"), "label"))
    out = keyed.withColumn("k", key).join(by_class, ["k", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all rows, labels apart, cosine of 0.93 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / CASE WHEN list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))) BETWEEN 1e-100 AND 1e100
    THEN 1.0 ELSE list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))) END) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id,
  coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
