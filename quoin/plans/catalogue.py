"""The queries of the engine by name, and their DuckDB equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import boxes as B
from quoin.functions import numeric as N
from quoin.operators import depth as Z
from quoin.operators import detection as D
from quoin.operators import kernels as K
from quoin.operators import matching as M
from quoin.operators import planes as P3
from quoin.operators import policy as L
from quoin.operators import raster as R
from quoin.operators import retrieval as V
from quoin.operators import spatial as P
from quoin.operators import state as S

from . import views as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# Retrieval

UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
COS = f"""v AS (SELECT vec_id, label, {UNIT} AS e FROM embeddings),
q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
c AS (SELECT vec_id, label, round(list_cosine_similarity(e, qe), 12) AS cosine FROM v, q WHERE vec_id <> 0)"""


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = W.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return e.where("vec_id <> 0").select("vec_id", "label", "embedding"), V.query_vector(e, F.col("vec_id") == 0)


@query(f"""WITH {COS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS quota_rank FROM c),
g AS (SELECT label, row_number() OVER (ORDER BY cosine DESC, vec_id) AS group_rank FROM k WHERE quota_rank = 1)
SELECT label, CAST(group_rank AS BIGINT) AS group_rank, CAST(quota_rank AS BIGINT) AS quota_rank, vec_id, round(cosine, 9) AS cosine
FROM k JOIN g USING (label) WHERE group_rank <= 5 AND quota_rank <= 2""")
def retrieval_topk_quota(spark, sf):
    """The five best groups for vector 0, two views each."""
    views, q = _views(spark, sf)
    out = V.top_groups(views, q, "label", 5, 2)
    return out.select("label", F.col("group_rank").cast("long"), F.col("quota_rank").cast("long"), "vec_id", F.round("cosine", 9).alias("cosine"))


@query(f"WITH {COS} SELECT vec_id, round(cosine, 9) AS cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS view_rank FROM c")
def retrieval_rank_all(spark, sf):
    views, q = _views(spark, sf)
    return V.ranked(views, q).select("vec_id", F.round("cosine", 9).alias("cosine"), F.col("view_rank").cast("long"))


@query(f"""WITH v AS (SELECT vec_id, {UNIT} AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
SELECT vec_id, round(norm, 9) AS norm, round(list_sum(list_transform(e, lambda x: x / norm)), 9) AS unit_sum FROM n""")
def descriptor_normalize(spark, sf):
    e = N.doubles(F.col("embedding"))
    return W.table(spark, sf, "embeddings").select("vec_id", F.round(N.norm(e), 9).alias("norm"), F.round(F.aggregate(N.unit(e), F.lit(0.0), lambda a, x: a + x), 9).alias("unit_sum"))


@query(f"""WITH v AS (SELECT vec_id, label, {UNIT} AS e FROM embeddings),
p AS (SELECT q.vec_id AS q, q.label AS ql, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 12) AS c FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS r FROM p),
f AS (SELECT q, min(CASE WHEN ql = label THEN r END) AS first FROM r WHERE r <= 10 GROUP BY q)
SELECT CAST(k AS BIGINT) AS k, count(*) FILTER (first <= k) AS hits, count(*) AS n, round(count(*) FILTER (first <= k) / count(*), 6) AS recall FROM f, (VALUES (1), (5), (10)) t(k) GROUP BY k""")
def descriptor_recall_at_k(spark, sf):
    """The query set is the rows whose vec_id is divisible by 50."""
    e = W.table(spark, sf, "embeddings")
    return rounded(V.recall(e.where("vec_id % 50 = 0"), e, "label", (1, 5, 10)).withColumn("k", F.col("k").cast("long")))


@query("""WITH d AS (SELECT (n_chars % 1000) / 1000.0 AS s, quality = 1 AS c FROM documents JOIN labels USING (doc_id))
SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (s >= t) AS accepted, count(*) FILTER (s >= t AND c) AS "right",
round(count(*) FILTER (s >= t) / count(*), 6) AS coverage, round(count(*) FILTER (s >= t AND c) / count(*) FILTER (s >= t), 6) AS precision
FROM d, (VALUES (0.1), (0.3), (0.5), (0.7)) x(t) GROUP BY t""")
def precision_coverage(spark, sf):
    d = W.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score")).join(W.table(spark, sf, "labels"), "doc_id").withColumn("correct", F.col("quality") == 1)
    return rounded(S.precision_coverage(d, [0.1, 0.3, 0.5, 0.7]))


# Detections

RAW = {
    "img": "img", "ord": "ord", "category": "CASE WHEN ord % 11 = 0 THEN 'sky' WHEN kind = 'door' THEN ' Door. ' WHEN ord % 5 = 0 THEN concat(chr(9), 'WINDOW.', chr(10)) ELSE 'window' END",
    "score": "CASE WHEN ord % 7 = 0 THEN score + 1 ELSE score END", "x0": "x0", "y0": "y0", "x1": "CASE WHEN img % 13 = 0 THEN x0 - 1 ELSE x1 END", "y1": "y1",
    "tx0": "CAST((img % 3) * 300 AS DOUBLE)", "ty0": "0.0", "tx1": "CAST((img % 3) * 300 + 420 AS DOUBLE)", "ty1": "333.0", "w": "1020.0", "h": "333.0",
}
RAW_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + " FROM det)"
FULL_SQL = """f0 AS (SELECT *, regexp_replace(lower(regexp_replace(category, '^\\s+|\\s+$', '', 'g')), '\\.+$', '') AS class, tx1 - tx0 AS tw, ty1 - ty0 AS th,
  greatest(0.0, least(x0, tx1 - tx0)) AS a0, greatest(0.0, least(x1, tx1 - tx0)) AS a1, greatest(0.0, least(y0, ty1 - ty0)) AS b0, greatest(0.0, least(y1, ty1 - ty0)) AS b1 FROM raw),
f AS (SELECT *, a1 > a0 AND b1 > b0 AND NOT ((tx0 > 0 AND a0 <= 12) OR (ty0 > 0 AND b0 <= 12) OR (tx1 < w AND a1 >= tw - 12) OR (ty1 < h AND b1 >= th - 12)) AS fits FROM f0)"""


def _raw(spark, sf):
    return W.detections(spark, sf).selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" if c in ("ty0", "ty1", "w", "h") else f"{e} AS {c}" for c, e in RAW.items()])


@query(f"""WITH {W.DET_SQL}, {RAW_SQL}, {FULL_SQL} SELECT img, CAST(ord AS BIGINT) AS ord, class,
CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'invalid_bbox_or_score' WHEN class NOT IN ('window', 'door') THEN 'unexpected_category' WHEN NOT fits THEN 'invalid_or_internal_tile_edge' END AS reject_reason FROM f""")
def detection_validate(spark, sf):
    return D.validate(_raw(spark, sf)).select("img", F.col("ord").cast("long"), "class", "reject_reason")


@query(f"""WITH {W.DET_SQL}, {RAW_SQL}, {FULL_SQL} SELECT img, CAST(ord AS BIGINT) AS ord, a0 + tx0 AS fx0, b0 + ty0 AS fy0, a1 + tx0 AS fx1, b1 + ty0 AS fy1 FROM f WHERE fits""")
def tile_box_to_full(spark, sf):
    full = B.to_full(B.Box.at(), B.Box(*(F.col(c) for c in ("tx0", "ty0", "tx1", "ty1"))), F.col("w"), F.col("h"))
    return _raw(spark, sf).withColumn("full", full).where("full IS NOT NULL").select("img", F.col("ord").cast("long"), *[F.col(f"full.{c}").alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])


@query("""WITH i AS (SELECT p_partkey, CAST(200 + p_size * 60 AS BIGINT) AS w, CAST(300 + (p_partkey % 40) * 55 AS BIGINT) AS h FROM part),
s AS (SELECT *, CASE WHEN w <= 1200 THEN [0] ELSE list_distinct(list_concat(range(0, w - 1200 + 1, 900), [w - 1200])) END AS xs,
  CASE WHEN h <= 1000 THEN [0] ELSE list_distinct(list_concat(range(0, h - 1000 + 1, 700), [h - 1000])) END AS ys FROM i),
t AS (SELECT p_partkey, w, h, unnest(xs) AS x0, ys FROM s), u AS (SELECT p_partkey, w, h, x0, unnest(ys) AS y0 FROM t)
SELECT p_partkey, 'tile_' || row_number() OVER (PARTITION BY p_partkey ORDER BY y0, x0) AS name, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(least(x0 + 1200, w) AS BIGINT) AS x1, CAST(least(y0 + 1000, h) AS BIGINT) AS y1 FROM u""")
def tile_grid(spark, sf):
    i = W.table(spark, sf, "part").select("p_partkey", (200 + F.col("p_size") * 60).alias("width"), (300 + F.col("p_partkey") % 40 * 55).alias("height"))
    return D.tiles(i).select("p_partkey", "name", *[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])


def inter_sql(a, b):
    return f"(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"


def area_sql(a):
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def iou_sql(a, b):
    return f"({inter_sql(a, b)} / greatest({area_sql(a)} + {area_sql(b)} - {inter_sql(a, b)}, 1e-12))"


def same_sql(a, b):
    s, g = f"least({area_sql(a)}, {area_sql(b)})", f"greatest({area_sql(a)}, {area_sql(b)})"
    near = " AND ".join(f"abs(({a}.{c}0 + {a}.{c}1) / 2 - ({b}.{c}0 + {b}.{c}1) / 2) <= 0.30 * greatest({a}.{c}1 - {a}.{c}0, {b}.{c}1 - {b}.{c}0)" for c in "xy")
    return f"({iou_sql(a, b)} > 0.45 OR ({s} > 0 AND {inter_sql(a, b)} / {s} >= 0.90 AND {s} / {g} >= 0.25 AND {near}))"


PAIRS_SQL = "det a JOIN det b ON a.img = b.img AND a.ord < b.ord"


@query(f"WITH {W.DET_SQL} SELECT a.img, a.ord AS a_ord, b.ord AS b_ord, round({iou_sql('a', 'b')}, 6) AS iou FROM {PAIRS_SQL} WHERE {iou_sql('a', 'b')} > 0.45")
def iou_pairs(spark, sf):
    v = B.iou(B.Box.at("a."), B.Box.at("b."))
    return D.pairs(W.detections(spark, sf)).where(v > B.SAME_IOU).select("a.img", F.col("a.ord").cast("long").alias("a_ord"), F.col("b.ord").cast("long").alias("b_ord"), F.round(v, 6).alias("iou"))


@query(f"WITH {W.DET_SQL} SELECT a.img, a.ord AS a_ord, b.ord AS b_ord FROM {PAIRS_SQL} WHERE {same_sql('a', 'b')}")
def same_opening_pairs(spark, sf):
    return D.pairs(W.detections(spark, sf)).where(B.same_opening(B.Box.at("a."), B.Box.at("b."))).select("a.img", F.col("a.ord").cast("long").alias("a_ord"), F.col("b.ord").cast("long").alias("b_ord"))


FITS = f"len(list_filter(m, lambda o: NOT {same_sql('o', 'r[1][1]')})) = 0"
GROUPS_SQL = f"""items AS (SELECT img, list([[{{'neg': -score, 'kind': kind, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}]] ORDER BY ord) AS l FROM det GROUP BY img),
folded AS (SELECT img, list_reduce(l, lambda g, r: CASE WHEN list_position(list_transform(g, lambda m: {FITS}), true) > 0
  THEN list_transform(g, lambda m, i: CASE WHEN i = list_position(list_transform(g, lambda m: {FITS}), true) THEN list_append(m, r[1][1]) ELSE m END) ELSE list_append(g, r[1]) END) AS g FROM items),
grouped AS (SELECT img, unnest(g) AS m, generate_subscripts(g, 1) - 1 AS grp FROM folded),
dd AS (SELECT img, grp, CASE WHEN len(list_distinct(list_transform(m, lambda o: o.kind))) > 1 THEN 'ambiguous' ELSE m[1].kind END AS class, -m[1].neg AS score, m[1].x0 AS x0, m[1].y0 AS y0, m[1].x1 AS x1, m[1].y1 AS y1, len(m) AS n_candidates, m FROM grouped)"""


@query(f"WITH {W.DET_SQL}, {GROUPS_SQL} SELECT img, CAST(grp AS BIGINT) AS grp, class, score, x0, y0, x1, y1, CAST(n_candidates AS BIGINT) AS n_candidates FROM dd")
def dedupe_greedy(spark, sf):
    return D.deduplicate(W.detections(spark, sf)).select("img", F.col("grp").cast("long"), "class", "score", "x0", "y0", "x1", "y1", F.col("n_candidates").cast("long"))


@query(f"""WITH {W.DET_SQL}, {GROUPS_SQL} SELECT img, CAST(grp AS BIGINT) AS grp, list_max(list_transform(list_filter(m, lambda o: o.kind = 'door'), lambda o: -o.neg)) AS door_score,
list_max(list_transform(list_filter(m, lambda o: o.kind = 'window'), lambda o: -o.neg)) AS window_score FROM dd WHERE class = 'ambiguous'""")
def class_conflict_report(spark, sf):
    d = D.deduplicate(W.detections(spark, sf)).where("review_required")
    return d.select("img", F.col("grp").cast("long"), *[F.try_element_at("class_scores", F.lit(k)).alias(f"{k}_score") for k in ("door", "window")])


@query(f"WITH {W.DET_SQL}, {GROUPS_SQL} SELECT img, count(*) FILTER (class = 'window') AS n_window, count(*) FILTER (class = 'door') AS n_door, count(*) FILTER (class = 'ambiguous') AS n_ambiguous, count(*) AS n FROM dd GROUP BY img")
def detection_counts(spark, sf):
    return D.counts(D.deduplicate(W.detections(spark, sf)))


_CELL = "coalesce('[' || string_agg(CASE WHEN class = '{0}' THEN j END, ',' ORDER BY CAST(round(x0) AS BIGINT), CAST(round(y0) AS BIGINT), CAST(round(x1) AS BIGINT), CAST(round(y1) AS BIGINT)) || ']', '[]') AS \"{0}\""


@query(f"""WITH {W.DET_SQL}, {GROUPS_SQL}, j AS (SELECT *, '[' || concat_ws(',', CAST(round(x0) AS BIGINT), CAST(round(y0) AS BIGINT), CAST(round(x1) AS BIGINT), CAST(round(y1) AS BIGINT)) || ']' AS j FROM dd WHERE class <> 'ambiguous')
SELECT img, {_CELL.format('window')}, {_CELL.format('door')} FROM j GROUP BY img""")
def interop_box_csv(spark, sf):
    return D.interop(D.deduplicate(W.detections(spark, sf)))


@query(f"""WITH {W.DET_SQL} SELECT CASE WHEN kind <> 'window' OR score < 0.20 THEN 'not_window_or_low_score' WHEN x0 < 4 OR y0 < 4 OR 450 - x1 < 4 OR 330 - y1 < 4 THEN 'near_border' ELSE 'kept' END AS reason, count(*) AS n FROM det GROUP BY 1""")
def reject_reason_counts(spark, sf):
    """Anchor filter with counters, in the order of its tests."""
    b = B.Box.at()
    near = (b.x0 < 4) | (b.y0 < 4) | (450 - b.x1 < 4) | (330 - b.y1 < 4)
    reason = F.when(B.parsed(b).isNull(), "invalid").when((F.col("kind") != "window") | (F.col("score") < 0.20), "not_window_or_low_score").when(near, "near_border").otherwise("kept")
    return W.detections(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {W.DET_SQL} SELECT img, CAST(ord AS BIGINT) AS ord, round((x1 - x0) * (y1 - y0), 6) AS area FROM det")
def polygon_area(spark, sf):
    b = B.Box.at()
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in R.corners(b)])
    return W.detections(spark, sf).select("img", F.col("ord").cast("long"), F.round(N.signed_area(ring), 6).alias("area"))


@query(f"""WITH {W.DET_SQL} SELECT img, CAST(ord AS BIGINT) AS ord, printf('v %.9f %.9f %.9f', x0 / 100, 0.0, y0 / 100) AS line FROM det""")
def obj_lines(spark, sf):
    from quoin.sources.obj import vertex_line

    return W.detections(spark, sf).select("img", F.col("ord").cast("long"), vertex_line(F.col("x0") / 100, F.lit(0.0), F.col("y0") / 100).alias("line"))


# Matching

h = W.H
PROJ = f"(px * {h[0]} + py * {h[1]} + {h[2]}) / (px * {h[6]} + py * {h[7]} + {h[8]})", f"(px * {h[3]} + py * {h[4]} + {h[5]}) / (px * {h[6]} + py * {h[7]} + {h[8]})"
ERR_SQL = f"e AS (SELECT *, sqrt(pow({PROJ[0]} - rx, 2) + pow({PROJ[1]} - ry, 2)) AS error FROM m)"
CELL_SQL = "least(floor((px + 0.5) / 1000 * 8), 7)", "least(floor((py + 0.5) / 600 * 4), 3)"


def _errors(spark, sf):
    p = N.project(F.col("px"), F.col("py"), W.H)
    return W.matches(spark, sf).withColumn("p", p).withColumn("error", F.sqrt(F.pow(F.col("p.x") - F.col("rx"), 2) + F.pow(F.col("p.y") - F.col("ry"), 2)))


@query(f"WITH {W.MATCH_SQL} SELECT cand, ord, round({PROJ[0]}, 6) AS x, round({PROJ[1]}, 6) AS y FROM m")
def homography_project(spark, sf):
    p = N.project(F.col("px"), F.col("py"), W.H)
    return W.matches(spark, sf).select("cand", F.col("ord").cast("long"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query(f"WITH {W.MATCH_SQL} SELECT cand, ord, round((px / 500 - 1 + 1) * 800 / 2 - 0.5 + 40, 6) AS x, round((py / 300 - 1 + 1) * 500 / 2 - 0.5 + 25, 6) AS y FROM m")
def normalized_to_pixel(spark, sf):
    f = lambda c, half, size, off: F.round(N.to_pixels(F.col(c) / half - 1, F.lit(size), F.lit(off)), 6)
    return W.matches(spark, sf).select("cand", F.col("ord").cast("long"), f("px", 500, 800, 40).alias("x"), f("py", 300, 500, 25).alias("y"))


#: Some points lie beside the photo or nowhere: they are on neither side.
HELD_X = "CASE WHEN ord % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE px * 1.04 - 20 END"


@query(f"""WITH {W.MATCH_SQL}, h AS (SELECT cand, ord, {HELD_X} AS px, py FROM m), k AS (SELECT *, NOT isnan(px) AND px >= -0.5 AND px < 999.5 AND py >= -0.5 AND py < 599.5 AS ok FROM h)
SELECT cand, ord, CASE WHEN ok THEN CAST({CELL_SQL[0]} AS BIGINT) END AS cx, CASE WHEN ok THEN CAST({CELL_SQL[1]} AS BIGINT) END AS cy, CASE WHEN ok THEN CAST({CELL_SQL[0]} + {CELL_SQL[1]} AS BIGINT) % 3 = 0 END AS holdout FROM k""")
def spatial_holdout(spark, sf):
    x, y = F.expr(HELD_X), F.col("py")
    cx, cy, held = N.holdout_cell(x, y, F.lit(1000), F.lit(600))
    return W.matches(spark, sf).select("cand", F.col("ord").cast("long"), cx.cast("long").alias("cx"), cy.cast("long").alias("cy"), held.alias("holdout"))


@query("""SELECT event_type, round(quantile_disc(value, 0.5), 6) AS median, round(quantile_disc(value, 0.9), 6) AS p90, round(max(value), 6) AS most, CAST(count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS BIGINT) AS nonfinite FROM events GROUP BY event_type""")
def error_summary_nearest_rank(spark, sf):
    e = W.table(spark, sf, "events")
    bad = F.count_if(~B.finite(F.col("value")))
    return e.groupBy("event_type").agg(F.round(N.nearest_rank("value", 0.5), 6).alias("median"), F.round(N.nearest_rank("value", 0.9), 6).alias("p90"), F.round(F.when(bad == 0, F.max("value")), 6).alias("most"), bad.alias("nonfinite"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def error_summary_linear(spark, sf):
    e = W.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.round(N.linear_percentile(F.col("value"), 0.5), 6).alias("median"), F.round(N.linear_percentile(F.col("value"), 0.9), 6).alias("p90"))


def _metrics(spark, sf):
    _, _, held = N.holdout_cell(F.col("px"), F.col("py"), F.lit(1000), F.lit(600))
    e = _errors(spark, sf).withColumn("holdout", held)
    near = F.col("error") <= 4
    return e.groupBy("cand").agg(
        F.count_if(~F.col("holdout")).alias("n_train"), F.count_if("holdout").alias("n_holdout"), F.count_if(~F.col("holdout") & near).alias("train_inliers"),
        (F.count_if(F.col("holdout") & near) / F.greatest(F.lit(1), F.count_if("holdout"))).alias("holdout_fraction"), N.nearest_rank("error", 0.5).alias("median_px"),
        ((F.max("px") - F.min("px")) / 1000).alias("x_span"), ((F.max("py") - F.min("py")) / 600).alias("y_span"))


METRICS_SQL = f"""k AS (SELECT *, CAST({CELL_SQL[0]} + {CELL_SQL[1]} AS BIGINT) % 3 = 0 AS holdout FROM e),
mt AS (SELECT cand, count(*) FILTER (NOT holdout) AS n_train, count(*) FILTER (holdout) AS n_holdout, count(*) FILTER (NOT holdout AND error <= 4) AS train_inliers,
  count(*) FILTER (holdout AND error <= 4) / greatest(1, count(*) FILTER (holdout)) AS holdout_fraction, quantile_disc(error, 0.5) AS median_px,
  (max(px) - min(px)) / 1000 AS x_span, (max(py) - min(py)) / 600 AS y_span FROM k GROUP BY cand)"""


@query(f"WITH {W.MATCH_SQL}, {ERR_SQL}, {METRICS_SQL} SELECT cand, n_train, n_holdout, train_inliers, round(holdout_fraction, 6) AS holdout_fraction, round(median_px, 6) AS median_px, round(x_span, 6) AS x_span, round(y_span, 6) AS y_span FROM mt")
def fit_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


@query(f"""WITH {W.MATCH_SQL}, {ERR_SQL}, {METRICS_SQL} SELECT cand, holdout_fraction >= 0.3 AND train_inliers >= 40 AND median_px <= 15 AND x_span >= 0.5 AS gate_passed,
concat_ws(',', CASE WHEN NOT holdout_fraction >= 0.3 THEN 'holdout' END, CASE WHEN NOT train_inliers >= 40 THEN 'inliers' END, CASE WHEN NOT median_px <= 15 THEN 'median' END, CASE WHEN NOT x_span >= 0.5 THEN 'span' END) AS failed FROM mt""")
def gate_checks(spark, sf):
    checks = {"holdout": F.col("holdout_fraction") >= 0.3, "inliers": F.col("train_inliers") >= 40, "median": F.col("median_px") <= 15, "span": F.col("x_span") >= 0.5}
    return M.gates(_metrics(spark, sf), checks).select("cand", "gate_passed", F.concat_ws(",", "failed_checks").alias("failed"))


@query(f"""WITH {W.MATCH_SQL}, {W.OBJECTS_SQL}, s AS (SELECT m.cand, m.weight, o.wall_id FROM m LEFT JOIN o ON m.object_index = o.object_index AND o.kind IN ('WallSurface', 'Window', 'Door') AND o.wall_id IS NOT NULL WHERE weight > 0),
n AS (SELECT cand, count(*) AS positive, count(wall_id) AS on_walls, sum(CASE WHEN wall_id IS NOT NULL THEN weight END) AS total FROM s GROUP BY cand),
v AS (SELECT cand, wall_id, count(*) AS votes, sum(weight) AS w FROM s WHERE wall_id IS NOT NULL GROUP BY cand, wall_id),
t AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY w DESC, votes DESC, wall_id) AS r FROM v)
SELECT n.cand, t.wall_id, votes, round(w / total, 6) AS share, round(on_walls / greatest(positive, 1), 6) AS visible, coalesce(votes >= 8 AND w / total >= 0.60 AND on_walls / greatest(positive, 1) >= 0.50, false) AS accepted FROM n LEFT JOIN t ON t.cand = n.cand AND r = 1""")
def wall_vote(spark, sf):
    out = M.vote(W.matches(spark, sf), W.objects(spark), "cand")
    return rounded(out.select("cand", "wall_id", "votes", "share", "visible", "accepted"))


CANDIDATE = {
    "run": "o_custkey % 500", "candidate_id": "o_orderkey", "building_id": "o_custkey % 7", "wall_id": "o_orderkey % 3",
    "score": "round((o_orderkey * 31 % 100) / 100.0 * least(1.0, ((o_custkey * 17 % 100) / 100.0) / 0.60), 6)",
    "gate_passed": "o_orderstatus <> 'F'", "vote_accepted": "o_orderkey % 5 <> 0",
}
CANDIDATE_SQL = "c AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in CANDIDATE.items()) + " FROM orders)"


@query(f"""WITH {CANDIDATE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, candidate_id) AS r FROM c WHERE gate_passed AND vote_accepted AND score IS NOT NULL),
j AS (SELECT c.run, b.candidate_id AS best_id, b.score AS best_score, max(CASE WHEN b.candidate_id IS NOT NULL AND (c.building_id <> b.building_id OR c.wall_id <> b.wall_id) THEN c.score END) AS runner_score FROM c LEFT JOIN b ON b.run = c.run AND r = 1 GROUP BY ALL)
SELECT run, best_id, best_score, runner_score, round(best_score - coalesce(runner_score, 0), 6) AS margin,
coalesce(round(best_score, 6) >= 0.35 AND best_score - coalesce(runner_score, 0) >= 0.08, false) AS accepted,
CASE WHEN best_id IS NULL THEN 'no_candidate_passed_geometry' WHEN best_score >= 0.35 AND best_score - coalesce(runner_score, 0) >= 0.08 THEN 'automatic_checks_passed' ELSE 'ambiguous_candidates' END AS reason FROM j""")
def candidate_selection(spark, sf):
    c = W.table(spark, sf, "orders").selectExpr(*[f"CAST({e} AS DOUBLE) AS {k}" if k == "score" else f"{e} AS {k}" for k, e in CANDIDATE.items()]).withColumn("ord", F.col("candidate_id"))
    return rounded(M.select_candidate(c, "run").select("run", "best_id", "best_score", "runner_score", "margin", "accepted", "reason"))


VIEW = {"building_id": "o_custkey % 40", "view_name": "'view_' || CAST(o_orderkey % 8 AS STRING)", "wall_id": "'w' || CAST(o_orderkey % 5 AS STRING)"}
VIEW_SQL = "vw AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in VIEW.items()).replace("STRING", "VARCHAR") + ", CAST(sum(o_orderkey % 1000) AS BIGINT) AS pixels FROM orders GROUP BY 1, 2, 3)"


def _wall_views(spark, sf):
    v = W.table(spark, sf, "orders").selectExpr(*[f"{e} AS {k}" for k, e in VIEW.items()], "o_orderkey % 1000 AS p")
    return v.groupBy("building_id", "view_name", "wall_id").agg(F.sum("p").alias("pixels"))


@query(f"""WITH {VIEW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY building_id, view_name ORDER BY pixels DESC, wall_id) AS r, max(pixels) OVER (PARTITION BY building_id, view_name) AS top FROM vw),
l AS (SELECT * FROM r WHERE r <= 2 AND pixels >= greatest(500.0, top * 0.30) AND wall_id = 'w' || (building_id % 5) AND view_name <> 'view_' || (building_id % 8)),
k AS (SELECT *, row_number() OVER (PARTITION BY building_id, wall_id ORDER BY pixels DESC, view_name) AS choice FROM l)
SELECT building_id, wall_id, view_name, pixels, choice FROM k WHERE choice <= 2""")
def confirmation_views(spark, sf):
    views = _wall_views(spark, sf)
    chosen = views.select("building_id", F.concat(F.lit("w"), (F.col("building_id") % 5).cast("string")).alias("wall_id")).distinct()
    seen = chosen.withColumn("view_name", F.concat(F.lit("view_"), (F.col("building_id") % 8).cast("string")))
    return M.confirmation_views(chosen, seen, views).select("building_id", "wall_id", "view_name", "pixels", F.col("choice").cast("long"))


@query(f"""WITH {W.MATCH_SQL}, {ERR_SQL}, a AS (SELECT cand, px, py, avg(error) AS error FROM e GROUP BY cand, px, py),
p AS (SELECT a.cand, abs(a.error - b.error) / 10 AS d FROM a JOIN a b ON b.cand = a.cand + 1 AND a.px = b.px)
SELECT cand, count(d) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, count(d) >= 6 AND quantile_cont(d, 0.5) <= 0.30 AND quantile_cont(d, 0.9) <= 0.75 AS passed FROM p GROUP BY cand""")
def cross_view_agreement(spark, sf):
    e = _errors(spark, sf).select("cand", "px", "py", "error").repartition("cand")  # also serves the pairs
    a = e.groupBy("cand", "px", "py").agg(F.avg("error").alias("error"))
    b = a.withColumn("cand", F.col("cand") - 1)
    return rounded(M.pair_agreement(a, b, "cand", "px", "error", 10.0))


SPOTS = {"a": "SELECT s_nationkey AS g, s_suppkey AS id, CAST((s_suppkey * 7919) % 997 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 499 AS DOUBLE) AS y, 20.0 + s_suppkey % 9 AS w, 30.0 + s_suppkey % 7 AS h FROM supplier",
         "b": "SELECT c_nationkey AS g, c_custkey AS id, CAST((c_custkey * 6151) % 997 AS DOUBLE) AS x, CAST((c_custkey * 3571) % 499 AS DOUBLE) AS y, 22.0 + c_custkey % 11 AS w, 28.0 + c_custkey % 13 AS h FROM customer"}
SPOTS_SQL = ", ".join(f"{k} AS ({v})" for k, v in SPOTS.items())


def _spots(spark, sf):
    keyed = {"a": ("supplier", "s_suppkey", "s_nationkey", 7919, 104729, (20.0, 9), (30.0, 7)), "b": ("customer", "c_custkey", "c_nationkey", 6151, 3571, (22.0, 11), (28.0, 13))}
    for t, k, g, p, q, w, hh in keyed.values():
        i = F.col(k)
        yield W.table(spark, sf, t).select(F.col(g).alias("g"), i.alias("id"), (i * p % 997).cast("double").alias("x"), (i * q % 499).cast("double").alias("y"), (w[0] + i % w[1]).alias("w"), (hh[0] + i % hh[1]).alias("h"))


@query(f"""WITH {SPOTS_SQL}, p AS (SELECT a.g, a.id AS a_id, b.id AS b_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM a JOIN b ON a.g = b.g WHERE a.w / b.w BETWEEN 0.55 AND 1.8 AND a.h / b.h BETWEEN 0.55 AND 1.8),
r AS (SELECT *, row_number() OVER (PARTITION BY g, a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY g, b_id ORDER BY d, a_id) AS rb FROM p WHERE d <= 30) SELECT g, a_id, b_id, round(d, 6) AS distance FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nearest(spark, sf):
    a, b = _spots(spark, sf)
    return rounded(M.mutual_nearest(a, b, "g").select("g", "a_id", "b_id", "distance"))


@query(f"WITH {SPOTS_SQL} SELECT p.g, p.id, round(min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6) AS nearest FROM a p JOIN a q ON p.g = q.g AND p.id <> q.id GROUP BY p.g, p.id")
def pairwise_spacing(spark, sf):
    return rounded(M.spacing(next(iter(_spots(spark, sf))), "g"))


PIX = "x AS (SELECT event_id AS ord, user_id % 100 AS px, event_id * 31 % 60 AS py, round(value, 2) AS confidence FROM events)"


def _pixels_of_events(spark, sf):
    return W.table(spark, sf, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 100).alias("px"), (F.col("event_id") * 31 % 60).alias("py"), F.round("value", 2).alias("confidence"))


@query(f"WITH {PIX}, r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY confidence DESC, ord) AS r FROM x) SELECT ord, px, py, confidence FROM r WHERE r = 1")
def pixel_dedup(spark, sf):
    return M.deduplicate_pixels(_pixels_of_events(spark, sf), ["px", "py"])


@query(f"WITH {PIX}, r AS (SELECT *, row_number() OVER (PARTITION BY px // 7, py // 15 ORDER BY confidence, ord) AS r FROM x) SELECT ord, px, py, confidence FROM r WHERE r = 1 ORDER BY confidence, ord LIMIT 50")
def display_thinning(spark, sf):
    """Its limit is the feature: at most 50 matches are shown."""
    x = _pixels_of_events(spark, sf).withColumns({"cx": F.expr("px div 7"), "cy": F.expr("py div 15")})
    return M.thin(x, "confidence", ["cx", "cy"]).select("ord", "px", "py", "confidence")


# Rasters and mapping

TRI = {"view_id": "p_size", "tri_id": "p_partkey", "object_index": "CAST(p_partkey % 7 + 1 AS INT)", "x": "CAST((p_partkey * 37) % 60 AS DOUBLE)", "y": "CAST((p_partkey * 53) % 40 AS DOUBLE)", "s": "8.0 + p_partkey % 11", "z": "10.0 + p_partkey % 23"}
COVER_SQL = f"""t AS (SELECT {', '.join(f'{e} AS {k}' for k, e in TRI.items())} FROM part),
px AS (SELECT t.*, gx, gy FROM t, range(0, 80) a(gx), range(0, 60) b(gy) WHERE gx >= x AND gy >= y AND (gx - x) + (gy - y) <= s),
cov AS (SELECT view_id, CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, tri_id, object_index, z + ((gx - x) + (gy - y)) / s * 4 AS depth FROM px),
zb AS (SELECT view_id, x, y, object_index, depth FROM (SELECT *, row_number() OVER (PARTITION BY view_id, x, y ORDER BY round(depth, 9), tri_id) AS r FROM cov) WHERE r = 1)"""


def _zbuffer(spark, sf):
    """Right-angled triangles; depth grows by 4 from the right angle to the far edge."""
    t = W.table(spark, sf, "part").selectExpr(*[f"{e} AS {k}" for k, e in TRI.items()])
    d = lambda c: F.col(c).cast("double")
    t = t.select("view_id", "tri_id", "object_index", d("x").alias("ax"), d("y").alias("ay"), d("z").alias("az"), (d("x") + d("s")).alias("bx"), d("y").alias("by"), (d("z") + 4).alias("bz"), d("x").alias("cx"), (d("y") + d("s")).alias("cy"), (d("z") + 4).alias("cz"))
    return Z.visible(t, 80, 60, digits=9)


@query(f"WITH {COVER_SQL} SELECT view_id, x, y, object_index, round(depth, 6) AS depth FROM zb")
def zbuffer_visibility(spark, sf):
    return rounded(_zbuffer(spark, sf))


@query(f"""WITH {COVER_SQL}, {W.OBJECTS_SQL}, s AS (SELECT view_id, wall_id, count(*) AS pixels, count(DISTINCT zb.object_index) AS n_objects FROM zb JOIN o ON o.object_index = zb.object_index WHERE wall_id IS NOT NULL GROUP BY view_id, wall_id)
SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY pixels DESC, wall_id) AS rank FROM s""")
def visible_walls(spark, sf):
    out = R.visible_walls(_zbuffer(spark, sf), W.objects(spark))
    return out.select("view_id", "wall_id", "pixels", F.size("objects").cast("long").alias("n_objects"), F.col("rank").cast("long"))


@query(f"""WITH {COVER_SQL}, {W.OBJECTS_SQL}, s AS (SELECT view_id, wall_id, count(*) AS pixels, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM zb JOIN o ON o.object_index = zb.object_index WHERE wall_id IS NOT NULL GROUP BY view_id, wall_id),
r AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY pixels DESC, wall_id) AS r, max(pixels) OVER (PARTITION BY view_id) AS top FROM s)
SELECT view_id, wall_id, pixels, CAST(greatest(a - 4, 0) AS BIGINT) AS x0, CAST(greatest(c - 4, 0) AS BIGINT) AS y0, CAST(least(b + 5, 80) AS BIGINT) AS x1, CAST(least(d + 5, 60) AS BIGINT) AS y1
FROM r WHERE r <= 2 AND pixels >= greatest(500.0, top * 0.30) AND b - a >= 32 AND d - c >= 32""")
def wall_crops(spark, sf):
    z = _zbuffer(spark, sf).join(W.objects(spark).where("wall_id IS NOT NULL"), "object_index").withColumns({"w": F.lit(80), "h": F.lit(60)})
    return M.wall_crops(z).select("view_id", "wall_id", "pixels", *[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {W.MATCH_SQL} SELECT cand, ord, round(px, 6) AS x, round(py, 6) AS y, round(confidence + 5, 6) AS z FROM m")
def camera_roundtrip(spark, sf):
    """Pixel and depth to local coordinates and back."""
    m = W.matches(spark, sf).withColumn("l", R.affine(W.PIXEL_TO_LOCAL, F.col("px"), F.col("py"), F.col("confidence") + 5))
    back = R.affine(R.inverse(W.PIXEL_TO_LOCAL), F.col("l.x"), F.col("l.y"), F.col("l.z"))
    return m.withColumn("b", back).select("cand", F.col("ord").cast("long"), *[(F.round(f"b.{c}", 6) + 0.0).alias(c) for c in "xyz"])


@query(f"WITH {W.MATCH_SQL} SELECT cand, ord, round(0.02 * px - 10, 6) + 0.0 AS u, round(10 - 0.02 * py, 6) + 0.0 AS v, 20.0::DOUBLE AS depth FROM m")
def ray_plane(spark, sf):
    m = W.matches(spark, sf).withColumn("r", R.ray_plane(F.col("px"), F.col("py"), W.PIXEL_TO_LOCAL, W.FRAME))
    return m.select("cand", F.col("ord").cast("long"), *[(F.round(f"r.{c}", 6) + 0.0).alias(c) for c in ("u", "v", "depth")])


def _corner_sql(fmt: str) -> str:
    return " AND ".join("(" + fmt.format(x=x, y=y) + ")" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))


def _at(x: str, y: str) -> tuple[str, str]:
    w = f"({x} * {h[6]} + {y} * {h[7]} + {h[8]})"
    return f"(({x} * {h[0]} + {y} * {h[1]} + {h[2]}) / {w})", f"(({x} * {h[3]} + {y} * {h[4]} + {h[5]}) / {w})"


_X, _Y = _at("{x}", "{y}")


@query(f"""WITH {W.DET_SQL} SELECT img, CAST(ord AS BIGINT) AS ord, CASE WHEN x0 < 0 OR y0 < 0 OR x1 > 450 OR y1 > 330 THEN 'box_outside_photo'
WHEN x0 <= 1e-6 OR y0 <= 1e-6 OR x1 >= 450 - 1e-6 OR y1 >= 330 - 1e-6 THEN 'box_touches_photo_border_may_be_incomplete'
WHEN NOT ({_corner_sql(f'{_X} >= -0.5 AND {_X} < 419.5 AND {_Y} >= -0.5 AND {_Y} < 319.5')}) THEN 'mapped_box_outside_render_image'
WHEN NOT ({_corner_sql(f'0.02 * {_X} - 10 BETWEEN -9.03 AND -2.97 AND 10 - 0.02 * {_Y} BETWEEN 4.97 AND 9.53')}) THEN 'mapped_box_not_fully_inside_wall_outer_boundary' END AS reject_reason FROM det""")
def mapping_rejects(spark, sf):
    det = W.detections(spark, sf).withColumn("class", F.col("kind"))
    out = R.map_boxes(det, W.H, (450, 330), (420, 320), W.PIXEL_TO_LOCAL, W.FRAME, (-9.0, 5.0, -3.0, 9.5))
    return out.select("img", F.col("ord").cast("long"), "reject_reason")


@query(f"""WITH {COVER_SQL}, {W.DET_SQL}, b AS (SELECT img, ord, img % 50 + 1 AS view_id, x0 / 5 AS x0, y0 / 5 AS y0, x1 / 5 AS x1, y1 / 5 AS y1 FROM det),
g AS (SELECT b.*, i, j, x0 + (0.1::DOUBLE + j * (1 - 2 * 0.1::DOUBLE) / 4) * (x1 - x0) AS sx, y0 + (0.1::DOUBLE + i * (1 - 2 * 0.1::DOUBLE) / 4) * (y1 - y0) AS sy FROM b, range(0, 5) r(i), range(0, 5) c(j)),
s AS (SELECT g.*, coalesce(zb.object_index, -1) AS oi FROM g LEFT JOIN zb ON zb.view_id = g.view_id AND zb.x = CAST(floor(sx + 0.5) AS INT) AND zb.y = CAST(floor(sy + 0.5) AS INT))
SELECT img, CAST(ord AS BIGINT) AS ord, round(avg(CASE WHEN oi BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS same_wall, round(avg(CASE WHEN oi >= 0 AND NOT oi BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS other_surface FROM s GROUP BY img, ord""")
def visibility_samples(spark, sf):
    det = W.detections(spark, sf).select("img", "ord", F.concat_ws("/", "img", "ord").alias("k"), (F.col("img") % 50 + 1).cast("int").alias("view_id"), *[(F.col(c) / 5).alias(c) for c in ("x0", "y0", "x1", "y1")])
    allowed = W.table(spark, sf, "part").select(F.col("p_size").alias("view_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("object_index")).distinct()
    v = R.visibility(det, (1, 0, 0, 0, 1, 0, 0, 0, 1), _zbuffer(spark, sf), allowed, "k")
    return rounded(v.select(F.split("k", "/")[0].cast("long").alias("img"), F.split("k", "/")[1].cast("long").alias("ord"), "same_wall", "other_surface"))


# Identity, states, evaluation, space

@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_identity(spark, sf):
    return W.table(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text")).alias("sha256"))


@query("""WITH c AS (SELECT sha256(text) AS k, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 2 = 0 DESC, source DESC, doc_id DESC) AS r FROM documents)
SELECT d.doc_id, c.doc_id AS cached FROM documents d LEFT JOIN c ON c.k = sha256(d.text) AND r = 1""")
def cache_reuse(spark, sf):
    d = W.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("k"), "source")
    cache = d.select("k", F.col("doc_id").alias("cached"), (F.col("doc_id") % 2 == 0).alias("owned"), F.struct("source", "doc_id").alias("path"))
    return S.reuse(d.select("doc_id", "k"), cache, ["k"]).select("doc_id", "cached")


STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END"


@query(f"""WITH s AS (SELECT user_id % 50 AS run, user_id AS item, arg_max({STATE}, (ts, event_id)) AS state FROM events GROUP BY 1, 2),
r AS (SELECT run, count(*) FILTER (state = 'completed') AS n_complete, count(*) FILTER (state = 'failed') AS n_failed, count(*) AS n FROM s GROUP BY run)
SELECT *, n - n_complete - n_failed AS n_pending, CASE WHEN n_complete = n THEN 'complete' WHEN n - n_complete - n_failed > 0 THEN 'running' ELSE 'partial' END AS status FROM r""")
def batch_status(spark, sf):
    return S.roll_up(_states(spark, sf), "run")


@query(f"SELECT user_id % 50 AS run, user_id AS item, arg_max({STATE}, (ts, event_id)) AS state, max(event_id) FILTER (true) * 0 + arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_state(spark, sf):
    return _states(spark, sf)


def _states(spark, sf):
    e = W.table(spark, sf, "events").select((F.col("user_id") % 50).alias("run"), F.col("user_id").alias("item"), "ts", "event_id", F.expr(STATE).alias("state"))
    return S.latest_state(e, ["run", "item"], ["ts", "event_id"], ["state", "event_id"])


NEAR_SQL = f"""{SPOTS_SQL}, n AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance, degrees(atan2(b.x - a.x, b.y - a.y)) AS d0 FROM a JOIN b ON abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
near AS (SELECT a_id, b_id, distance, CASE WHEN d0 < 0 THEN d0 + 360 ELSE d0 END AS bearing FROM n WHERE distance <= 30)"""


@query(f"WITH {NEAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS rank FROM near) SELECT a_id, b_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def nearest_building(spark, sf):
    a, b = _spots(spark, sf)
    return rounded(P.nearest(a, b, 30.0).select("a_id", "b_id", "distance", F.col("rank").cast("long")))


@query(f"WITH {NEAR_SQL} SELECT a_id, b_id, round(bearing, 6) AS bearing FROM near WHERE least(abs(bearing - a_id * 17 % 360), 360 - abs(bearing - a_id * 17 % 360)) <= 45")
def bearing_filter(spark, sf):
    a, b = _spots(spark, sf)
    p = P.within(a, b, 30.0).withColumn("heading", (F.col("a_id") * 17 % 360).cast("double"))
    return rounded(P.facing(p).select("a_id", "b_id", "bearing"))


@query("""WITH g AS (SELECT label, vec_id, (CAST(label AS BIGINT) * 2654435761 % 4294967296) % 10 AS b FROM embeddings)
SELECT vec_id, label, CASE WHEN b < 7 THEN 'train' WHEN b < 8 THEN 'validate' ELSE 'test' END AS split FROM g""")
def grouped_split(spark, sf):
    return W.table(spark, sf, "embeddings").select("vec_id", "label", S.grouped_split(F.col("label"), {"train": 7, "validate": 1, "test": 2}).alias("split"))


# Policies

@query(f"""WITH {COVER_SQL}, f AS (SELECT view_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM zb GROUP BY view_id), p AS (SELECT *, greatest(1, ceil(greatest(b - a + 1, d - c + 1) * 0.02)) AS pad FROM f)
SELECT view_id, CAST(greatest(0, a - pad) AS BIGINT) AS x0, CAST(greatest(0, c - pad) AS BIGINT) AS y0, CAST(least(80, b + 1 + pad) AS BIGINT) AS x1, CAST(least(60, d + 1 + pad) AS BIGINT) AS y1 FROM p""")
def foreground_box(spark, sf):
    return L.foreground(_zbuffer(spark, sf).withColumns({"w": F.lit(80), "h": F.lit(60)}), "view_id")


@query(f"""WITH {COVER_SQL}, {W.OBJECTS_SQL}, s AS (SELECT view_id % 5 AS building_id, view_id, sum(CASE WHEN kind IN ('Window', 'Door') THEN 1 ELSE 0 END) AS n FROM zb JOIN o ON o.object_index = zb.object_index GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY n DESC, view_id) AS r FROM s) SELECT building_id, view_id, CAST(n AS BIGINT) AS opening_pixels FROM r WHERE r = 1""")
def overview_views(spark, sf):
    v = _zbuffer(spark, sf).groupBy((F.col("view_id") % 5).alias("building_id"), "view_id", "object_index").agg(F.count("*").alias("pixels")).withColumn("ord", F.col("view_id"))
    return L.overview_view(v, W.objects(spark), "building_id", "view_id", "ord").drop("ord")


def _calibrated(spark, sf):
    return _errors(spark, sf).select("cand", "ord", "px", "py", F.when(F.col("ord") % 40 == 0, "check").otherwise("control").alias("role"), (F.col("error") / 100).alias("error_m"))


@query(f"""WITH {W.MATCH_SQL}, {ERR_SQL}, c AS (SELECT cand, px, py, CASE WHEN ord % 40 = 0 THEN 'check' ELSE 'control' END AS role, error / 100 AS e FROM e),
d AS (SELECT k.cand, min(sqrt(pow(k.px - c.px, 2) + pow(k.py - c.py, 2))) AS apart FROM c k JOIN c ON k.cand = c.cand AND k.role = 'check' AND c.role = 'control' GROUP BY k.cand),
s AS (SELECT cand, sqrt(avg(e * e) FILTER (role = 'control')) AS rmse_m, max(e) FILTER (role = 'check') AS check_max_m, count(*) FILTER (role = 'check') AS checks FROM c GROUP BY cand)
SELECT s.cand, round(rmse_m, 6) AS rmse_m, round(check_max_m, 6) AS check_max_m, round(apart, 6) AS apart, CASE WHEN checks < 1 THEN 'no_checks' WHEN apart < 5 THEN 'check_too_close_to_control' WHEN rmse_m > 0.2 OR check_max_m > 0.3 THEN 'errors_too_large' END AS reject_reason FROM s LEFT JOIN d USING (cand)""")
def calibration_quality(spark, sf):
    """All matches of each cand."""
    return rounded(L.calibration(_calibrated(spark, sf), "cand").drop("checks"))


@query(f"""WITH {W.MATCH_SQL}, {ERR_SQL} SELECT cand, count(*) AS n, round(max(error / 100), 6) AS max_m, round(quantile_cont(error / 100, 0.5), 6) AS median_m, count(*) >= 4 AND max(error / 100) <= 0.3 AND quantile_cont(error / 100, 0.5) <= 0.2 AS passed FROM e GROUP BY cand""")
def manual_reference_check(spark, sf):
    return rounded(L.manual_check(_errors(spark, sf).withColumn("error_m", F.col("error") / 100), "cand").drop("nonfinite"))


@query("""WITH w AS (SELECT c_nationkey AS building, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'w' || (c_custkey % 13) END AS wall_id, 1.0 * (c_custkey % 5) AS nx, 1.0 AS ny, (c_custkey % 4) * 0.05 AS nz, c_acctbal AS area, c_custkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY area DESC, wall_id DESC) AS r FROM w WHERE wall_id IS NOT NULL AND area > 1e-10 AND abs(nz) / sqrt(nx * nx + ny * ny + nz * nz) <= sin(radians(5))) SELECT building, wall_id, round(area, 6) AS area FROM r WHERE r = 1""")
def reference_wall(spark, sf):
    k = F.col("c_custkey")
    w = W.table(spark, sf, "customer").select(F.col("c_nationkey").alias("building"), F.when(k % 9 != 0, F.concat(F.lit("w"), (k % 13).cast("string"))).alias("wall_id"), (k % 5).cast("double").alias("nx"), F.lit(1.0).alias("ny"), ((k % 4) * 0.05).alias("nz"), F.col("c_acctbal").alias("area"))
    return rounded(L.reference_wall(w, "building").select("building", "wall_id", "area"))


@query(f"""WITH {W.DET_SQL} SELECT img, x0, y0, x1, y1, printf('R%02d', row_number() OVER (PARTITION BY img ORDER BY x0, y0, x1, y1)) AS review_id FROM det""")
def review_numbers(spark, sf):
    return L.review_ids(W.detections(spark, sf), "img").select("img", "x0", "y0", "x1", "y1", "review_id")


@query(f"""WITH i AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 900 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 700 AS DOUBLE) AS y0, 4.0 * p_size AS s FROM part), t AS (SELECT id, x0, y0, x0 + s AS x1, y0 + s AS y1 FROM i),
u AS (SELECT id, unnest([{_at('(x0 - 0.5)', '(y0 - 0.5)')[0]}, {_at('(x1 - 0.5)', '(y0 - 0.5)')[0]}, {_at('(x1 - 0.5)', '(y1 - 0.5)')[0]}, {_at('(x0 - 0.5)', '(y1 - 0.5)')[0]}]) AS x, unnest([{_at('(x0 - 0.5)', '(y0 - 0.5)')[1]}, {_at('(x1 - 0.5)', '(y0 - 0.5)')[1]}, {_at('(x1 - 0.5)', '(y1 - 0.5)')[1]}, {_at('(x0 - 0.5)', '(y1 - 0.5)')[1]}]) AS y FROM t),
b AS (SELECT id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM u GROUP BY id),
l AS (SELECT id, greatest(a - 0.1 * (b - a), -0.5) AS lx, greatest(c - 0.1 * (d - c), -0.5) AS ly, least(b + 0.1 * (b - a), 799.5) AS hx, least(d + 0.1 * (d - c), 599.5) AS hy FROM b)
SELECT id, CASE WHEN hx - lx < 32 OR hy - ly < 32 THEN 'render_crop_outside_image_or_too_small' END AS skip_reason, CASE WHEN NOT (hx - lx < 32 OR hy - ly < 32) THEN CAST(floor(lx + 0.5) AS INT) END AS cx0 FROM l""")
def tile_eligibility(spark, sf):
    k = F.col("p_partkey")
    t = W.table(spark, sf, "part").select(k.alias("id"), (k * 37 % 900).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0"), (F.col("p_size") * 4.0).alias("s"))
    t = t.withColumns({"x1": F.col("x0") + F.col("s"), "y1": F.col("y0") + F.col("s")})
    return L.tile_eligibility(t, W.H, (800, 600)).select("id", "skip_reason", "cx0")


# Kernels without an SQL form

@query()
def view_agreement(spark, sf):
    """A run for each supplier with three views of a wall; the second is off by up to 15 pixels (0.3 m), the third fails
    its gate in every fifth run and is the only other view in every seventh."""
    k, v = F.col("s_suppkey"), F.col("v")
    s = W.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v")).where((k % 7 != 0) | (v != 1))
    h = [F.lit(float(x)) + (F.when(v == 1, (k % 4) * 5.0).otherwise(0.0) if i == 2 else 0.0) for i, x in enumerate(W.H)]
    c = s.select("s_suppkey", v.alias("candidate_id"), F.lit("b").alias("building_id"), F.lit("w").alias("wall_id"), F.concat(F.lit("view"), v).alias("view_name"), ((v != 2) | (k % 5 != 0)).alias("gate_passed"), F.lit(True).alias("vote_accepted"), F.array(*h).alias("h"), F.array(*[F.lit(x) for r in W.PIXEL_TO_LOCAL for x in r]).alias("camera"), *[F.array(*map(F.lit, x)).alias(n) for n, x in W.FRAME.items()])
    p = spark.range(3 * 140 * 80).select(F.lit("b").alias("building_id"), F.concat(F.lit("view"), F.col("id") % 3).alias("view_name"), (F.floor(F.col("id") / 3) % 140).alias("x"), F.floor(F.col("id") / 420).alias("y"), F.lit("w").alias("wall_id"))
    return M.view_agreement(c.where("candidate_id = 0").select("s_suppkey", "candidate_id"), c, p, (100, 60), "s_suppkey").withColumn("error", F.lit(None).cast("string"))


@query()
def homography_fit(spark, sf):
    m = W.matches(spark, sf)
    p = N.project(F.col("px"), F.col("py"), W.H)
    far = F.col("confidence") < 0.2
    m = m.withColumns({"rx": p["x"] + F.when(far, 40.0).otherwise(0.1) * (F.col("ord") % 3 - 1), "ry": p["y"] + F.when(far, -25.0).otherwise(0.1) * (F.col("ord") % 2)})
    m = m.withColumn("holdout", N.holdout_cell(F.col("px"), F.col("py"), F.lit(1000), F.lit(600))[2])
    return K.fit_groups(m, "cand", (1000, 600))


@query(f"""WITH {SPOTS_SQL}, p AS (SELECT g, x, 5 + 0.75 * x AS y, y AS z FROM b)
SELECT g, round(avg(x), 6) AS ox, round(avg(y), 6) AS oy, round(avg(z), 6) AS oz, 0.8::DOUBLE AS ux, 0.6::DOUBLE AS uy, 0.0::DOUBLE AS uz, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 1.0::DOUBLE AS vz, 0.0::DOUBLE AS deviation, CAST(NULL AS VARCHAR) AS error FROM p GROUP BY g""")
def plane_frame(spark, sf):
    """The frame of a slanting wall for each nation, from its customers' spots on it."""
    _, b = _spots(spark, sf)
    f = P3.frames(b.select("g", "x", (5 + F.col("x") * 0.75).alias("y"), F.col("y").alias("z")), "g")
    part = lambda c, n: [(F.round(F.get(c, F.lit(i)), 6) + 0.0).alias(f"{n}{x}") for i, x in enumerate("xyz")]
    return f.select("g", *part("origin", "o"), *part("u", "u"), *part("v", "v"), F.round("deviation", 6).alias("deviation"), "error")


@query()
def hull_coverage(spark, sf):
    return K.coverage_groups(W.matches(spark, sf, numbered=False), "cand", ["px", "py"], 1000, 600)


@query("""SELECT s_suppkey, CAST(12 AS DOUBLE) AS n, round((2 * sqrt(2) - 2 * 0.04) * pow(s_suppkey % 5 + 1, 2), 6) AS area, CAST(NULL AS VARCHAR) AS error FROM supplier""")
def triangulate(spark, sf):
    """A ring of eight corners with a square hole for each supplier; its area is that of its triangles."""

    def run(p: np.ndarray) -> dict:
        t = K.triangulate(p[:8], [p[8:]])
        return {"n": float(len(t)), "area": float(sum(abs(K.area(x)) for x in t))}

    angle = F.radians(F.col("ord") * 45.0)
    ring = F.when(F.col("ord") < 8, F.cos(angle)).otherwise(F.cos(angle + 0.1) * 0.2), F.when(F.col("ord") < 8, F.sin(angle)).otherwise(F.sin(angle + 0.1) * 0.2)
    s = W.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("o")).withColumn("ord", F.when(F.col("o") < 8, F.col("o")).otherwise(F.col("o") * 2 - 8))
    s = s.withColumns({"x": ring[0] * (F.col("s_suppkey") % 5 + 1), "y": ring[1] * (F.col("s_suppkey") % 5 + 1)})
    return rounded(K.per_group(s, "s_suppkey", ["x", "y"], run, "n double, area double"))


@query("SELECT p_partkey, CAST(1 AS DOUBLE) AS rings, CAST(p_size % 4 + 1 AS DOUBLE) AS area, CAST(NULL AS VARCHAR) AS error FROM part")
def polygon_union(spark, sf):
    """Outer boundary of a strip of unit squares for each part."""

    def run(p: np.ndarray) -> dict:
        r = K.outer_rings(list(p.reshape(-1, 4, 2)))
        return {"rings": float(len(r)), "area": float(sum(K.area(x) for x in r))}

    n = F.col("p_size") % 4 + 1
    s = W.table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), n * 4 - 1)).alias("ord"))
    q, c = F.expr("ord div 4"), F.col("ord") % 4
    s = s.withColumns({"x": (q + F.when(c.isin(1, 2), 1).otherwise(0)).cast("double"), "y": F.when(c >= 2, 1.0).otherwise(0.0)})
    return K.per_group(s, "p_partkey", ["x", "y"], run, "rings double, area double")
