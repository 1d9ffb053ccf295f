"""Steps whose rows or tasks must not grow faster than the input."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.operators import depth as Z
from quoin.operators import guided as T
from quoin.operators import kernels as K
from quoin.operators import mapping as G
from quoin.operators import overlay as O
from quoin.operators import raster as R
from quoin.operators import spatial as P
from quoin.plans import views as W

ONE = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pixels_and_boxes(spark):
    """Pixels over six tiles, with gaps, and boxes on them, beside them and nowhere."""
    rng = random.Random(5)
    shown = {(f"v{v}", x, y): rng.choice([1, 1, 1, 1, 2, 3]) for v in range(2) for x in range(150) for y in range(90) if (x + y) % 50}
    pixels = spark.createDataFrame([(*k, o) for k, o in shown.items()], "view_id string, x int, y int, object_index int")
    boxes = [(i, f"v{i % 3}", *(float(v) for v in (x, y, x + rng.uniform(1, 90), y + rng.uniform(1, 60)))) for i in range(200) for x, y in [(rng.uniform(-40, 150), rng.uniform(-30, 90))]]
    boxes += [(900, "v0", 1e300, 0.0, 1e308, 1.0), (901, "v0", math.nan, 0.0, 1.0, 1.0), (902, "v1", -3e9, -3e9, 3e9, 3e9)]
    return shown, pixels, boxes, spark.createDataFrame(boxes, "i int, view_id string, x0 double, y0 double, x1 double, y1 double")


def plain_shares(shown, box, own):
    _, v, x0, y0, x1, y1 = box
    steps = [0.1 + i * (1 - 2 * 0.1) / 4 for i in range(5)]
    points = [(x0 + fx * (x1 - x0), y0 + fy * (y1 - y0)) for fy in steps for fx in steps]
    seen = [shown.get((v, math.floor(x + 0.5), math.floor(y + 0.5)), -1) if math.isfinite(x) and math.isfinite(y) else -1 for x, y in points]
    return sum(o in own for o in seen) / 25, sum(o >= 0 and o not in own for o in seen) / 25, seen[12] in own


def test_points_of_boxes_are_no_rows(spark):
    shown, pixels, boxes, df = pixels_and_boxes(spark)
    allowed = spark.createDataFrame([(f"v{v}", o) for v in range(2) for o in (1, 3)], "view_id string, object_index int")
    out = R.visibility(df, ONE, pixels, allowed, "i")
    assert {r.i: (r.same_wall, r.other_surface, r.centre) for r in out.collect()} == {b[0]: plain_shares(shown, b, {1, 3}) for b in boxes}
    assert "fx" not in plan(out)  # one row for each point of a box had these


def test_shares_of_walls(spark):
    shown, pixels, boxes, df = pixels_and_boxes(spark)
    objects = spark.createDataFrame([("b", 1, "WallSurface", "A"), ("b", 2, "Window", "A"), ("b", 3, "WallSurface", "B"), ("b", 4, "RoofSurface", None)], "building_id string, object_index int, kind string, wall_id string")
    h = F.array(*[F.lit(float(x)) for x in ONE])
    asked = df.select("*", h.alias("h"), F.lit("b").alias("building_id"), F.when(F.col("i") % 7 == 0, "C").when(F.col("i") % 2 == 0, "A").otherwise("B").alias("wall_id"))
    out = G.seen_shares(asked, pixels, objects, ["i"])
    own = lambda i: set() if i % 7 == 0 else {1, 2} if i % 2 == 0 else {3}
    assert {r.i: (r.same_wall, r.other_surface) for r in out.collect()} == {b[0]: plain_shares(shown, b, own(b[0]))[:2] for b in boxes}
    assert "fx" not in plan(out)


def test_walls_are_met_outside_of_nested_arrays(spark):
    """Four corners in lambdas took milliseconds a detection."""
    det = spark.createDataFrame([("r", 1, "door", 1.0, 1.0, 2.0, 2.0)], "run string, ord int, class string, x0 double, y0 double, x1 double, y1 double")
    arrays = ", ".join(f"{c} array<double>" for c in ("h", "camera", "origin", "u", "v"))
    runs = spark.createDataFrame([("r", *[9.0] * 4, list(map(float, ONE)), [0.0] * 16, [0.0] * 3, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], f"run string, photo_w double, photo_h double, render_w double, render_h double, {arrays}")
    out = G.on_walls(det, runs, "run")
    assert "lambda" not in plan(out) and out.first().reject_reason == G.REASONS[6]


def test_one_small_file_of_triangles_is_drawn_by_many_tasks(spark):
    names = "view_id int, tri_id int, object_index int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
    rows = [(i % 9, i, 1, float(i % 50), 1.0, 1.0, 60.0, 1.0, 1.0, 1.0, 60.0, 1.0) for i in range(90)]
    t = Z.buffers(spark.createDataFrame(rows, names).coalesce(1), 64, 64)
    assert "REPARTITION_BY_NUM" in plan(t) and t.count() == 9


def test_tiles_of_few_files_are_planned_by_many_tasks(spark):
    pairs = spark.createDataFrame([(i, 900, 900, 1, 80, 60, list(map(float, ONE))) for i in range(50)], "pair int, photo_w int, photo_h int, view_id int, render_w int, render_h int, h array<double>").coalesce(1)
    assert T.crops(pairs, "pair").select(F.spark_partition_id()).distinct().count() > 1


def test_areas_of_many_groups_as_of_each(monkeypatch):
    """Groups of crossing, touching, empty and bad rings in one lot against one arrangement each; most make none."""
    rng = random.Random(8)
    groups = []
    for k in range(120):
        at = lambda: float(rng.choice([rng.randrange(12), rng.uniform(0, 12)]))  # noqa: B023, E731
        ring = lambda: [{"x": at(), "y": at()} for _ in range(rng.randrange(3, 7))]  # noqa: B023, E731
        box = lambda: (lambda x, y, w, h: [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])(at(), at(), at() + 1, at() + 1)  # noqa: B023, E731
        groups.append([[rng.choice([ring, box])() for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 6))])
    groups += [[[[{"x": math.nan, "y": 0.0}] * 3]], [[[{"x": 1.0, "y": 1.0}] * 3]], [[]], [groups[0][0], []], [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]]] * 70]
    point = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    made = []
    arrangement = O.Arrangement
    monkeypatch.setattr(O, "Arrangement", lambda p: made.append(len(p)) or arrangement(p))
    got, errors = O._areas(pa.array([None, *groups], point).slice(1))
    assert made == [70]
    for g, areas, error in zip(groups, got, errors, strict=True):
        try:
            a = arrangement(O._given(g, False))
            want = [O.size(a.region(rule)) for rule in (lambda m: m.any(axis=1), lambda m: m.all(axis=1), lambda m: m[:, 0] & ~m[:, 1:].any(axis=1))]
            assert error is None and np.allclose(areas, want, rtol=1e-9, atol=1e-6), (g, areas, want)
        except ValueError as x:
            assert error == str(x) and np.isnan(areas).all()


def test_numbers_of_matches_need_no_sort_of_a_candidate(spark):
    sf = "/root/testdata/sf0.001"
    m = W.matches(spark, sf)
    whole = Window.partitionBy("cand").orderBy(*W.MATCH_ORDER)
    assert m.groupBy("cand").agg(F.countDistinct("ord").alias("n"), F.max("ord").alias("m"), F.count("*").alias("k")).where("n <> k OR m <> k").count() == 0
    assert m.withColumn("r", F.row_number().over(whole)).where("r <> ord").count() == 0
    assert "_before" in plan(m) and "Window" not in plan(W.matches(spark, sf, numbered=False))


def test_hulls_from_parts(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(30)) if k < 3 else rng.gauss(0, 9), rng.gauss(0, 5)) for k in range(5) for _ in range(400)]
    rows += [(7, 1.0, 2.0), (7, 3.0, 4.0), (8, 1.0, 1.0), (8, 2.0, 2.0), (8, 3.0, 3.0), (9, math.nan, 1.0), (9, 1.0, 1.0), (9, 2.0, 5.0), (9, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(6)
    got = {r.k: (r.hull, r.x_span, r.y_span) for r in K.coverage_groups(df, "k", ["x", "y"], 100, 50).collect()}
    assert len(got) == 8 and got[7] == (0.0, 0.0, 0.0)
    for k, g in got.items():
        want = K.coverage(np.array([r[1:] for r in rows if r[0] == k]), 100, 50)
        assert np.allclose(np.array(g, dtype=float), list(want.values()), rtol=1e-12, equal_nan=True)
    assert "MapInPandas" in plan(K.coverage_groups(df, "k", ["x", "y"], 100, 50))


def test_samples_are_dropped_before_all_points_are_read(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 100, (3 * K.BLOCK, 2))
    h = np.array([[1.0, 0.1, 2], [0, 1, 3], [1e-3, 0, 1]])
    b = K.transform(h, a) + rng.normal(0, 3, a.shape)
    want = np.minimum(np.linalg.norm(K.transform(h, a) - b, axis=1), 4.0).sum()
    assert np.isclose(K.truncated(h, a, b, 4.0, np.inf), want, rtol=1e-12)
    seen, errors = [], K.errors
    monkeypatch.setattr(K, "errors", lambda h, a, b: seen.append(len(a)) or errors(h, a, b))
    assert K.truncated(h, a, b, 4.0, 9.0) == np.inf and seen == [K.BLOCK]


def test_small_groups_are_no_data_frames(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k in range(9) for i in (3, 1, 2)], "k int, ord int, x double").coalesce(1)
    out = K.per_group(df, "k", ["x"], lambda p: {"first": float(p[0, 0])}, "first double")
    assert {(r.k, r.first, r.error) for r in out.collect()} == {(k, 1.0, None) for k in range(9)}
    assert "Pandas" not in plan(out) and "REPARTITION_BY_NUM" in plan(out)


def test_pairs_in_a_radius_are_dealt(spark):
    rng = random.Random(4)
    a, b = ([(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(n)] for n in (60, 300))
    a += [(1000, 0.0, 0.0)]
    b += [(1000, 10.0, 0.0), (1001, -10.0, 0.0), (1002, 10.000001, 0.0)]
    df = [spark.createDataFrame(t, "id int, x double, y double").coalesce(1) for t in (a, b)]
    out = P.within(*df, 10.0)
    assert sorted((r.a_id, r.b_id) for r in out.collect()) == sorted((i, j) for i, x, y in a for j, u, v in b if math.sqrt((u - x) ** 2 + (v - y) ** 2) <= 10.0)
    assert plan(out).count("REPARTITION_BY_NUM") >= 2


def test_boxes_on_a_wall_are_worked_in_batches(spark):
    det = W.detections(spark, "/root/testdata/sf0.001").withColumn("class", F.col("kind"))
    out = R.map_boxes(det, W.H, (450, 330), (420, 320), W.PIXEL_TO_LOCAL, W.FRAME, (-9.0, 5.0, -3.0, 9.5))
    assert "MapInArrow" in plan(out)
    r = out.where("reject_reason IS NULL").first()
    assert r.area_m2 > 0 and len(r.uv) == 4 and out.where("uv IS NULL AND area_m2 IS NOT NULL").count() == 0


def test_many_inliers_are_fitted_in_blocks(monkeypatch):
    """All equations of a candidate with their factors were several times its matches."""
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 1000, (2 * K.BLOCK + 77, 2))
    h = np.array([[0.98, 0.02, 12.0], [-0.015, 1.01, 7.5], [2e-5, -3e-5, 1.0]])
    b = K.transform(h, a) + rng.normal(0, 0.3, a.shape)
    inliers = rng.random(len(a)) < 0.8
    want, seen, equations = K.fit_homography(a[inliers], b[inliers]), [], K.equations
    monkeypatch.setattr(K, "equations", lambda x, y: seen.append(len(x)) or equations(x, y))
    assert np.allclose(K.fit_inliers(a, b, inliers), want, rtol=1e-8, atol=1e-12) and max(seen) <= K.BLOCK
    line = np.stack([a[:, 0], a[:, 0]], axis=1)
    with np.testing.assert_raises(ValueError):
        K.fit_inliers(line, b, inliers)


def test_matches_of_a_candidate_are_no_data_frame(spark):
    rng = random.Random(9)
    rows = [(k, x, y, x + 2, y + 1, (i % 5 == 0) if i else None) for k in (None, 1, 2) for i in range(300) for x, y in [(rng.uniform(0, 99), rng.uniform(0, 99))]]
    df = spark.createDataFrame([*rows, (3, 1.0, 1.0, 1.0, 1.0, False)], "k int, px double, py double, rx double, ry double, holdout boolean")
    out = K.fit_groups(df, "k", (100, 100))
    assert "Pandas" not in plan(out)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {None, 1, 2, 3} and got[3].error and all(got[k].train_inliers == got[k].n_train == 240 and got[k].n_holdout == 59 for k in (None, 1, 2))
