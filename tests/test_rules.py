"""Rules at their limits: order of rejects, sizes, statuses, points that are nowhere."""

from pyspark.sql import functions as F

from quoin.functions import numeric as N
from quoin.operators import detection as D
from quoin.operators import kernels as K
from quoin.operators import matching as M
from quoin.operators import policy as L
from quoin.operators import raster as R

NAN, INF = float("nan"), float("inf")


def test_numbers_are_judged_before_the_category_and_empty_boxes_last(spark):
    rows = [
        ("sky", 2.0, 1.0, 1.0, 9.0, 9.0, "invalid_bbox_or_score"), ("sky", 0.5, 1.0, NAN, 9.0, 9.0, "invalid_bbox_or_score"), ("sky", 0.5, 9.0, 9.0, 1.0, 1.0, "unexpected_category"),
        ("door", 0.5, 9.0, 9.0, 1.0, 1.0, "invalid_or_internal_tile_edge"), ("door", 0.5, 9.0, 9.0, 9.0, 12.0, "invalid_or_internal_tile_edge"), ("door", None, 1.0, 1.0, 9.0, 9.0, "invalid_bbox_or_score"),
        ("Window.\n", 0.5, 1.0, 1.0, 9.0, 9.0, None), ("\tdoor\x1f", 1.0, 1.0, 1.0, 9.0, 9.0, None), (" Door.. ", 0.0, 1.0, 1.0, 9.0, 9.0, None), ("door. .", 0.5, 1.0, 1.0, 9.0, 9.0, "unexpected_category"),
    ]
    df = spark.createDataFrame([(i, *r[:6], 0.0, 0.0, 100.0, 100.0, 100.0, 100.0) for i, r in enumerate(rows)], "i int, category string, score double, x0 double, y0 double, x1 double, y1 double, tx0 double, ty0 double, tx1 double, ty1 double, w double, h double")
    assert [r.reject_reason for r in D.validate(df).orderBy("i").collect()] == [r[6] for r in rows]


def test_walls_are_more_than_thirty_two_pixels_apart_end_to_end(spark):
    rows = [("v", wall, x, y, 400, 300) for wall, last in (("w1", 131), ("w2", 132)) for x in range(100, last + 1) for y in range(100, 140)]
    got = M.wall_crops(spark.createDataFrame(rows, "view_id string, wall_id string, x int, y int, w int, h int")).collect()
    assert [(r.wall_id, r.x0, r.x1) for r in got] == [("w2", 96, 137)]


def test_a_run_with_skipped_tiles_is_partial(spark):
    tiles = spark.createDataFrame([(1, "a", "completed"), (1, "b", "skipped"), (2, "a", "completed"), (3, "a", "completed"), (4, "a", "failed"), (4, "b", "completed")], "run int, name string, status string")
    kept = spark.createDataFrame([(1, "a"), (2, "a"), (4, "b")], "run int, name string")
    assert {r.run: r.status for r in L.tile_report(tiles, kept, "run").collect()} == {1: "partial", 2: "complete", 3: "no_matches", 4: "partial"}


def test_points_that_are_nowhere_have_no_object(spark):
    points = [(i, "v", x, y) for i, (x, y) in enumerate([(0.0, 0.0), (NAN, 0.0), (0.0, INF), (-INF, 0.0), (1e300, 0.0), (-0.6, 0.0), (-0.5, 0.49), (None, 0.0)])]
    pixels = spark.createDataFrame([("v", 0, 0, 7, 2.5)], "view_id string, x int, y int, object_index int, depth double")
    got = R.at_pixel(spark.createDataFrame(points, "i int, view_id string, px double, py double"), pixels, "px", "py")
    assert {r.i: (r.object_index, r.depth) for r in got.collect()} == {i: (7, 2.5) if i in (0, 6) else (-1, None) for i in range(8)}


def test_points_beside_the_photo_are_on_neither_side(spark):
    xs = [(0.0, 0.0), (NAN, 0.0), (-1.0, 0.0), (999.4, 599.4), (999.5, 0.0), (0.0, INF), (None, 1.0)]
    cx, cy, held = N.holdout_cell(F.col("x"), F.col("y"), F.lit(1000), F.lit(600))
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(xs)], "i int, x double, y double").select("i", cx.alias("cx"), cy.alias("cy"), held.alias("held")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, True), (None,) * 3, (None,) * 3, (7, 3, False), (None,) * 3, (None,) * 3, (None,) * 3]


def test_fits_leave_points_out_that_are_on_neither_side(spark):
    grid = [(1, float(x), float(y), x + 5.0, y - 3.0) for x in range(0, 1000, 40) for y in range(3, 600, 40)]
    odd = [(1, NAN, 5.0, 5.0, 5.0), (1, -40.0, 5.0, 700.0, 300.0), (1, 20.0, 5.0, 5000.0, 5.0)]
    df = spark.createDataFrame(grid + odd, "cand int, px double, py double, rx double, ry double")
    df = df.withColumn("holdout", N.holdout_cell(F.col("px"), F.col("py"), F.lit(1000), F.lit(600))[2])
    r = K.fit_groups(df, "cand", (1000, 600), render=(1100, 700)).first()
    assert r.error is None and r.n_train + r.n_holdout == len(grid) and r.holdout_inlier_fraction == 1.0
