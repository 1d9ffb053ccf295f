"""Queries that compose several operators over stand-ins derived from the given tables; tests hold those without SQL twins
against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import guided as T
from quoin.operators import mapping as G
from quoin.operators import overlay as O

from . import views as W
from .catalogue import COVER_SQL, _zbuffer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# Mapping of boxes to walls of any outline

PHOTO, RENDER = (450.0, 330.0), (80.0, 60.0)
#: Photo to render, and by exception: one with a pole inside the photo, one that shrinks all to a point.
SHRUNK = [0.16 * x for x in W.H[:6]] + list(W.H[6:])
POLED = SHRUNK[:6] + [-1 / 200, 0.0, 1.0]
POINT = [1e-5, 0.0, 40.0, 0.0, 1e-5, 30.0, 0.0, 0.0, 1.0]
CAMERA = [0.1, 0.0, 0.0, -4.0, 0.0, 0.0, 1.0, -20.0, 0.0, -0.1, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0]


def mapping_tables(spark, sf):
    """Detections, runs, rings, pixels and objects: a run for each order, a house of two L-shaped walls for each
    supplier."""
    run = F.col("o_orderkey")
    row = lambda v: F.array(*[F.lit(float(x)) for x in v])
    h = F.when(run % 23 == 0, row(POLED)).when(run % 29 == 0, row(POINT)).otherwise(row(SHRUNK))
    lean = F.when(run % 11 == 0, row([0.0, 0.9998, 0.02])).otherwise(row([0.0, 0.0, 1.0]))
    sizes = [F.lit(v).alias(n) for n, v in zip(("photo_w", "photo_h", "render_w", "render_h"), (*PHOTO, *RENDER), strict=True)]
    house = W.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("house"))
    wall = lambda side: F.concat_ws("/", F.col("house").cast("string"), side)
    runs = W.table(spark, sf, "orders").join(house, "o_orderkey").select(run.alias("run"), *sizes, h.alias("h"), row(CAMERA).alias("camera"), row([0.0] * 3).alias("origin"), row([1.0, 0.0, 0.0]).alias("u"), lean.alias("v"),
        (run % 50 + 1).cast("int").alias("view_id"), F.col("house").cast("string").alias("building_id"), wall(F.when(run % 2 == 0, "w1").otherwise("w2")).alias("wall_id"))
    k = F.col("s_suppkey")
    x, y, s = (k * 37 % 20) / 10 - 4, (k * 53 % 10) / 10 - 3, 4.0 + k % 4
    corner = lambda fx, fy: F.struct((x + float(fx) * s).alias("x"), (y + float(fy) * s).alias("y"))
    shape = F.array(*[corner(*p) for p in ((0, 0), (1, 0), (1, 0.5), (0.6, 0.5), (0.6, 1), (0, 1))])
    sides = F.explode(F.array(F.lit("w1"), F.lit("w2"))).alias("side")
    rings = W.table(spark, sf, "supplier").select(k.alias("house"), shape.alias("points")).select("*", sides).select(wall(F.col("side")).alias("wall_id"), F.lit(0).alias("ring_id"), "points")
    det = W.detections(spark, sf).selectExpr("img AS run", "CAST(ord AS INT) AS ord", "CASE WHEN (img + ord) % 13 = 0 THEN 'sky' ELSE kind END AS class", "x0", "y0 - 3 AS y0", "CASE WHEN (img + ord) % 11 = 0 THEN x0 - 1 ELSE x0 + (x1 - x0) / (ord + 1) END AS x1", "y0 + (y1 - y0) / (ord + 1) - 3 AS y1")
    pixels = _zbuffer(spark, sf).select(F.col("view_id").cast("int").alias("view_id"), "x", "y", F.when(F.col("object_index") > 3, F.col("object_index")).otherwise(F.col("view_id") % 2 + 1).cast("int").alias("object_index"))
    mine = F.when(F.col("object_index") == 1, "w2").when(F.col("object_index") == 2, "w1").otherwise(F.col("wall_id"))
    houses = W.table(spark, sf, "supplier").select(k.alias("house"), F.explode(F.array(*[F.struct(F.lit(i).alias("object_index"), F.lit(kind).alias("kind"), F.lit(w).alias("wall_id")) for i, kind, w in W.OBJECTS])).alias("o")).select("house", "o.*")
    objects = houses.select(F.col("house").cast("string").alias("building_id"), "object_index", "kind", F.when(mine.isNotNull(), wall(mine)).alias("wall_id"))
    return det, runs, rings, pixels, objects


@query()
def mapping_chain(spark, sf):
    """Every detection with its place on the wall or the first of ten reasons against it."""
    out = G.map_runs(*mapping_tables(spark, sf), places=False)
    return out.select("run", "ord", "class", "wall_id", "prediction_id", "reject_reason", *[F.round(c, 6).alias(c) for c in ("same_wall", "other_surface", "width_m", "height_m", "area_m2")])


@query()
def mapping_statuses(spark, sf):
    """How many detections of each run were mapped, and its status."""
    return G.map_status(G.map_runs(*mapping_tables(spark, sf), places=False))


# Tiles that guide the matching

PAIR = {
    "pair": "p_partkey", "photo_w": "CAST(200 + p_size * 60 AS INT)", "photo_h": "CAST(300 + p_partkey % 40 * 55 AS INT)", "view_id": "CAST(p_size AS INT)",
    "h0": "CASE WHEN p_partkey % 19 = 0 THEN CAST(0.000001 AS DOUBLE) ELSE (40 + p_partkey % 60) / CAST(200 + p_size * 60 AS DOUBLE) END", "h2": "CAST(p_partkey % 7 * 8 - 20 AS DOUBLE)",
    "h4": "CASE WHEN p_partkey % 19 = 0 THEN CAST(0.000001 AS DOUBLE) ELSE (30 + p_partkey % 50) / CAST(300 + p_partkey % 40 * 55 AS DOUBLE) END", "h5": "CAST(p_partkey % 5 * 8 - 12 AS DOUBLE)",
    "h6": "CASE WHEN p_partkey % 17 = 0 THEN CAST(-0.003 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
}
NORM = "sqrt(h0 * h0 + h2 * h2 + h4 * h4 + h5 * h5 + h6 * h6 + 1)"
_AT = [(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
TILE_SQL = f"""{COVER_SQL}, i AS (SELECT {", ".join(f"{e} AS {k}" for k, e in PAIR.items())} FROM part),
n AS (SELECT pair, photo_w AS w, photo_h AS h, view_id, {", ".join(f"{k} / {NORM} AS {k}" for k in ("h0", "h2", "h4", "h5", "h6"))}, 1 / {NORM} AS h8 FROM i),
s AS (SELECT *, CASE WHEN w <= 1200 THEN [0] ELSE list_distinct(list_concat(range(0, w - 1200 + 1, 900), [w - 1200])) END AS xs, CASE WHEN h <= 1000 THEN [0] ELSE list_distinct(list_concat(range(0, h - 1000 + 1, 700), [h - 1000])) END AS ys FROM n),
t1 AS (SELECT *, unnest(xs) AS x0 FROM s), t2 AS (SELECT *, unnest(ys) AS y0 FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY y0, x0) AS k, least(x0 + 1200, w) AS x1, least(y0 + 1000, h) AS y1 FROM t2),
c AS (SELECT *, {", ".join(f"({x} - 0.5::DOUBLE) * h6 + h8 AS w{i}, (({x} - 0.5::DOUBLE) * h0 + h2) / (({x} - 0.5::DOUBLE) * h6 + h8) AS u{i}, (({y} - 0.5::DOUBLE) * h4 + h5) / (({x} - 0.5::DOUBLE) * h6 + h8) AS v{i}" for i, (x, y) in enumerate(_AT))} FROM t3),
e AS (SELECT *, greatest(u0, u1, u2, u3) - least(u0, u1, u2, u3) AS sx, greatest(v0, v1, v2, v3) - least(v0, v1, v2, v3) AS sy, abs({" + ".join(f"(u{i} * v{(i + 1) % 4} - u{(i + 1) % 4} * v{i})" for i in range(4))}) / 2 AS area FROM c),
l AS (SELECT *, greatest(least(u0, u1, u2, u3) - 0.1::DOUBLE * sx, -0.5) AS lx, greatest(least(v0, v1, v2, v3) - 0.1::DOUBLE * sy, -0.5) AS ly, least(greatest(u0, u1, u2, u3) + 0.1::DOUBLE * sx, 79.5) AS hx, least(greatest(v0, v1, v2, v3) + 0.1::DOUBLE * sy, 59.5) AS hy FROM e),
r AS (SELECT pair, view_id, k, lx, ly, hx, hy, CASE WHEN NOT (least(w0, w1, w2, w3) > 1e-12 OR greatest(w0, w1, w2, w3) < -1e-12) THEN 'projective_pole_crosses_photo_tile' WHEN sx < 1 OR sy < 1 OR area < 1 THEN 'degenerate_projected_tile' WHEN hx - lx < 32 OR hy - ly < 32 THEN 'render_crop_outside_image_or_too_small' END AS reason FROM l),
b AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(floor(lx + 0.5) AS INTEGER) END AS cx0, CASE WHEN reason IS NULL THEN CAST(ceil(hx + 0.5) AS INTEGER) END AS cx1, CASE WHEN reason IS NULL THEN CAST(floor(ly + 0.5) AS INTEGER) END AS cy0, CASE WHEN reason IS NULL THEN CAST(ceil(hy + 0.5) AS INTEGER) END AS cy1 FROM r),
m AS (SELECT b.pair, b.k, count(zb.x) AS n_wall FROM b LEFT JOIN zb ON zb.view_id = b.view_id AND zb.object_index = 1 AND zb.x >= cx0 AND zb.x < cx1 AND zb.y >= cy0 AND zb.y < cy1 WHERE reason IS NULL GROUP BY b.pair, b.k)"""


def guided_tables(spark, sf):
    """Pairs of photo and view from parts, the wall pixels of the views and their sizes."""
    nil = F.lit(0.0)
    pairs = W.table(spark, sf, "part").selectExpr(*[f"{e} AS {k}" for k, e in PAIR.items()])
    pairs = pairs.select("pair", "photo_w", "photo_h", "view_id", F.lit(80).alias("render_w"), F.lit(60).alias("render_h"), F.array("h0", nil, "h2", nil, "h4", "h5", "h6", nil, F.lit(1.0)).alias("h"))
    walls = _zbuffer(spark, sf).where("object_index = 1").select(F.col("view_id").cast("int").alias("view_id"), "x", "y")
    views = pairs.select("view_id", F.col("render_w").alias("w"), F.col("render_h").alias("h")).distinct()
    return pairs, walls, views


@query(f"""WITH {TILE_SQL} SELECT b.pair, 'tile_' || b.k AS name, cx0, cy0, cx1, cy1, CAST(n_wall AS BIGINT) AS n_wall, coalesce(reason, CASE WHEN n_wall = 0 THEN 'no_allowed_wall_in_render_crop' END) AS skip_reason FROM b LEFT JOIN m ON m.pair = b.pair AND m.k = b.k""")
def guided_tiles(spark, sf):
    """The render crop of each photo tile, or why it is skipped."""
    return T.plan_tiles(*guided_tables(spark, sf)).select("pair", "name", "cx0", "cy0", "cx1", "cy1", "n_wall", "skip_reason")


# Polygon overlay

_BOX = "b AS (SELECT img, ord, x0, y0, x1, y1 FROM det)"
_AXES = " ".join(f"{c}s AS (SELECT img, {c} AS lo, lead({c}) OVER (PARTITION BY img ORDER BY {c}) AS hi FROM (SELECT img, {c}0 AS {c} FROM b UNION SELECT img, {c}1 FROM b))," for c in "xy")
OVERLAY_SQL = f"""{W.DET_SQL}, {_BOX}, {_AXES}
n AS (SELECT img, count(*) AS n FROM b GROUP BY img),
c AS (SELECT xs.img, xs.lo AS xl, ys.lo AS yl, (xs.hi - xs.lo) * (ys.hi - ys.lo) AS size FROM xs JOIN ys ON xs.img = ys.img WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL),
k AS (SELECT c.img, c.xl, c.yl, any_value(c.size) AS size, count(b.img) AS held, count(*) FILTER (b.ord = 1) AS first FROM c LEFT JOIN b ON b.img = c.img AND b.x0 <= c.xl AND b.x1 > c.xl AND b.y0 <= c.yl AND b.y1 > c.yl GROUP BY c.img, c.xl, c.yl)"""


@query(f"""WITH {OVERLAY_SQL} SELECT k.img, round(coalesce(sum(size) FILTER (held > 0), 0), 3) AS union_area, round(coalesce(sum(size) FILTER (held = n), 0), 3) AS common_area, round(coalesce(sum(size) FILTER (first = 1 AND held = 1), 0), 3) AS first_only_area FROM k JOIN n ON n.img = k.img GROUP BY k.img""")
def polygon_overlay(spark, sf):
    """Of the boxes of each photo the area of their union, of what all share and of what only the best one holds."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(*[corner(f"x{i}", f"y{j}") for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    boxes = W.detections(spark, sf).select("img", "ord", F.array(ring).alias("rings"))
    return O.areas(boxes, "img").select("img", *[F.round(c, 3).alias(c) for c in ("union_area", "common_area", "first_only_area")])
