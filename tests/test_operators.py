"""Small tables with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import boxes as B
from quoin.functions import numeric as N
from quoin.operators import detection as D
from quoin.operators import kernels as K
from quoin.operators import matching as M
from quoin.operators import planes
from quoin.operators import raster as R
from quoin.operators import retrieval as V
from quoin.operators import state as S

DET = "img string, kind string, score double, x0 double, y0 double, x1 double, y1 double"


def groups(spark, rows):
    return D.deduplicate(spark.createDataFrame([("i", *r) for r in rows], DET)).orderBy("grp").collect()


def test_nested_windows_merge(spark):
    g = groups(spark, [("window", 0.559, 2311.3, 141.2, 2417.4, 277.3), ("window", 0.502, 2331.3, 168.1, 2384.2, 261.4)])
    assert len(g) == 1 and g[0].x0 == 2311.3


def test_class_conflict_is_ambiguous(spark):
    g = groups(spark, [("door", 0.532, 1906.1, 593.6, 1990.8, 824.8), ("window", 0.428, 1905.3, 595.1, 1987.5, 826.9)])
    assert len(g) == 1 and g[0]["class"] == "ambiguous" and g[0].review_required and g[0].class_scores == {"door": 0.532, "window": 0.428}


def test_neighbours_glass_and_chain_stay_apart(spark):
    assert len(groups(spark, [("window", 0.9, 0.0, 0.0, 100.0, 100.0), ("window", 0.8, 90.0, 0.0, 190.0, 100.0)])) == 2
    assert len(groups(spark, [("door", 0.9, 0.0, 0.0, 100.0, 200.0), ("window", 0.8, 40.0, 20.0, 60.0, 40.0)])) == 2
    assert len(groups(spark, [("window", s, x, 0.0, x + 100, 100.0) for s, x in ((0.9, 0.0), (0.8, 30.0), (0.7, 60.0))])) == 2


def test_validation_reasons(spark):
    rows = [("window", 0.5, 30.0, 40.0, 90.0, 95.0), ("sky", 0.5, 1.0, 1.0, 2.0, 2.0), ("door", 2.0, 1.0, 1.0, 2.0, 2.0), ("door", float("nan"), 1.0, 1.0, 2.0, 2.0), (" Window. ", 0.5, 9.0, 9.0, 2.0, 2.0), (None, 0.5, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame([(*r, 500.0, 500.0, 1700.0, 1500.0, 3000.0, 3000.0) for r in rows], "category string, score double, x0 double, y0 double, x1 double, y1 double, tx0 double, ty0 double, tx1 double, ty1 double, w double, h double")
    got = D.validate(df).collect()
    assert [r.reject_reason for r in got] == [None, "unexpected_category", "invalid_bbox_or_score", "invalid_bbox_or_score", "invalid_or_internal_tile_edge", "unexpected_category"]
    assert tuple(got[0].full) == (530.0, 540.0, 590.0, 595.0)


def test_tiles(spark):
    df = spark.createDataFrame([(2940, 833), (700, 600), (1700, 1500)], "width int, height int")
    t = [tuple(r)[3:] for r in D.tiles(df.where("width = 2940")).collect()]
    assert t == [(0, 0, 1200, 833), (900, 0, 2100, 833), (1740, 0, 2940, 833)]
    assert D.tiles(df.where("width = 700")).count() == 1
    assert D.tiles(df.where("width = 1700")).agg(F.max("x1"), F.max("y1")).first() == (1700, 1500)


def test_retrieval_quota(spark):
    v = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "A", [0.99, 0.01]), (3, "B", [0.8, 0.2]), (4, "C", [0.0, 1.0]), (5, "Z", [0.0, 0.0]), (6, "N", [float("nan"), 1.0])], "vec_id int, g string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [(r.g, r.vec_id) for r in V.top_groups(v, q, "g", 2, 1).orderBy("group_rank").collect()] == [("A", 1), ("B", 3)]
    assert [r.vec_id for r in V.ranked(v, q).orderBy("view_rank").collect()] == [1, 2, 3, 4]


def candidates(spark, rows):
    df = spark.createDataFrame([(1, i, str(i), *r) for i, r in enumerate(rows)], "run int, ord int, candidate_id string, building_id string, wall_id string, score double, gate_passed boolean, vote_accepted boolean")
    return M.select_candidate(df, "run").first()


def test_candidate_selection(spark):
    assert candidates(spark, [("a", "w", 0.80, True, True), ("b", "w", 0.76, True, True)]).reason == "ambiguous_candidates"
    assert candidates(spark, [("a", "w", 0.80, True, True), ("a", "w", 0.79, True, True), ("b", "w", 0.40, True, True)]).accepted
    assert not candidates(spark, [("a", "w", 0.80, True, True), ("b", "w", 0.85, False, True)]).accepted
    assert candidates(spark, [("a", "w", 0.99, False, True)]).reason == "no_candidate_passed_geometry"


def test_confirmation_views(spark):
    v = spark.createDataFrame([("B", n, "w", p) for n, p in (("b", 600), ("a", 1000), ("c", 800), ("edge", 4))], "building_id string, view_name string, wall_id string, pixels int")
    sel = spark.createDataFrame([("B", "w")], "building_id string, wall_id string")
    seen = spark.createDataFrame([], "building_id string, wall_id string, view_name string")
    assert [r.view_name for r in M.confirmation_views(sel, seen, v).orderBy("choice").collect()] == ["a", "c"]


def test_agreement_needs_enough_and_close_points(spark):
    df = spark.createDataFrame([("far", 1.0)] * 45 + [("near", 0.01)] * 6 + [("few", 0.0)] * 5, "k string, error double")
    assert {r.k: r.passed for r in M.agreement(df, "k").collect()} == {"far": False, "near": True, "few": False}


def test_pixels_and_percentiles(spark):
    df = spark.createDataFrame([(2.5,), (0.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(N.pixel(F.col("v"))).collect()] == [3, 1, 0]
    e = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("inf"),), (float("nan"),)], "e double")
    assert e.agg(N.nearest_rank("e", 0.5), N.nearest_rank("e", 0.9)).first() == (3.0, None)


def test_vote_keeps_unknown_objects_out(spark):
    o = spark.createDataFrame([(1, "WallSurface", "w"), (2, "RoofSurface", None)], "object_index int, kind string, wall_id string")
    p = lambda n, m: spark.createDataFrame([("k", 1, 1.0)] * n + [("k", 2, 1.0)] * m + [("k", -1, 0.0)], "k string, object_index int, weight double")
    assert M.vote(p(8, 8), o, "k").first().accepted
    assert not M.vote(p(8, 9), o, "k").first().accepted
    assert not M.vote(p(7, 0), o, "k").first().accepted


def test_zbuffer_is_independent_of_order(spark):
    t = [("v", 0, 7, 0.0, 0.0, 1.0, 20.0, 0.0, 5.0, 0.0, 20.0, 1.0), ("v", 1, 19, 0.0, 0.0, 5.0, 20.0, 0.0, 1.0, 0.0, 20.0, 5.0)]
    names = "view_id string, tri_id int, object_index int, " + ", ".join(f"{a}{b} double" for a in "abc" for b in "xyz")
    got = [{(r.x, r.y): r.object_index for r in R.zbuffer(R.cover(spark.createDataFrame(x, names), 21, 21)).collect()} for x in (t, t[::-1])]
    assert got[0] == got[1] and got[0][(4, 4)] == 7 and got[0][(13, 3)] == 19 and (20, 20) not in got[0]


def test_mapping_rejects_in_order(spark):
    boxes = [("window", 100.0, 100.0, 150.0, 150.0), ("tree", 1.0, 1.0, 2.0, 2.0), ("door", 5.0, 5.0, 1.0, 9.0), ("door", -1.0, 5.0, 9.0, 9.0), ("door", 0.0, 5.0, 9.0, 9.0), ("window", 390.0, 100.0, 396.0, 150.0)]
    det = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "id int, class string, x0 double, y0 double, x1 double, y1 double")
    m = ((0.05, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, -20.0), (0.0, -0.05, 0.0, 20.0), (0.0, 0.0, 0.0, 1.0))
    frame = {"origin": (0.0, 0.0, 0.0), "u": (1.0, 0.0, 0.0), "v": (0.0, 0.0, 1.0)}
    got = R.map_boxes(det, (1, 0, 0, 0, 1, 0, 0, 0, 1), (400, 400), (400, 400), m, frame, (0.0, 0.0, 15.0, 20.0)).orderBy("id").collect()
    assert [r.reject_reason for r in got] == [None, "unsupported_detection_class", "invalid_detection_box", "box_outside_photo", "box_touches_photo_border_may_be_incomplete", "mapped_box_not_fully_inside_wall_outer_boundary"]
    assert abs(got[0].area_m2 - 6.25) < 1e-9 and abs(got[0].width_m - 2.5) < 1e-9


def test_homography_ignores_held_out_rows():
    rng = np.random.default_rng(1)
    h = np.array([[1.02, 0.03, 12], [-0.02, 0.98, 30], [2e-5, -1e-5, 1]])
    a = rng.uniform([0, 0], [1000, 600], (1200, 2))
    b = K.transform(h, a) + rng.normal(0, 0.25, a.shape)
    b[:240] += rng.uniform(40, 200, (240, 2))
    got, inliers = K.ransac(a, b)
    corners = np.array([[0, 0], [1000, 0], [1000, 600], [0, 600]], float)
    assert np.abs(K.transform(got, corners) - K.transform(h, corners)).max() <= 0.25
    assert inliers[240:].mean() > 0.99
    with pytest.raises(ValueError):
        K.fit_homography(np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float), corners)


def test_polygons():
    outer = np.array([[0, 0], [5, 0], [5, 5], [0, 5]], float)
    hole = np.array([[1, 1], [3, 1], [3, 3], [1, 3]], float)
    assert abs(sum(abs(K.area(t)) for t in K.triangulate(outer, [hole])) - 21) < 1e-9
    notch = np.array([[0, 0], [10, 0], [10, 10], [6, 10], [6, 4], [4, 4], [4, 10], [0, 10]], float)
    assert K.inside_ring(np.array([[1, 1], [9, 1], [9, 3], [1, 3]], float), notch)
    assert not K.inside_ring(np.array([[1, 5], [9, 5], [9, 9], [1, 9]], float), notch)
    strip = [np.array([[i, 0], [i + 1, 0], [i + 1, 1], [i, 1]], float) for i in range(3)]
    assert [round(K.area(r), 6) for r in K.outer_rings(strip)] == [3.0]


def test_plane_frame_points_up_and_right():
    f = planes.plane_frame(np.array([[0, 5, 0], [4, 5, 0], [4, 5, 3], [0, 5, 3]], float))
    assert np.allclose(f["u"], [1, 0, 0]) and np.allclose(f["v"], [0, 0, 1])
    for wrong, why in (([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.5]], "planar"), ([[0, 0, 0], [1, 1, 1], [3, 3, 3]], "collinear"), ([[0, 0, 0], [1, 0, 0]], "collinear"), ([[0, 0, 0], [9, 0, 0.1], [9, 9, 0.1], [0, 9, 0]], "level")):
        with pytest.raises(ValueError, match=why):
            planes.plane_frame(np.array(wrong, float))


def test_frames_from_sums_are_those_of_the_points(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(40):
        n = rng.normal(size=3)
        n /= np.linalg.norm(n)
        a, b = np.linalg.svd(n[None])[2][1:]
        p = rng.normal(size=(8, 1)) * 9 * a + rng.normal(size=(8, 1)) * 4 * b + [691_000, 5_336_000, 500] + (0.005 if k % 3 else 0.5) * rng.uniform(-1, 1, size=(8, 1)) * n
        rows += [(k, *map(float, q)) for q in p]
        try:
            want[k] = planes.plane_frame(p)
        except ValueError as e:
            want[k] = str(e)
    assert {type(v) for v in want.values()} == {dict, str}
    for r in planes.frames(spark.createDataFrame(rows, "k int, x double, y double, z double").repartition(3), "k").collect():
        if r.error:
            assert r.error == want[r.k] and r.u is None
        else:
            f = want[r.k]
            assert np.allclose(r.u, f["u"], atol=1e-7) and np.allclose(r.v, f["v"], atol=1e-7) and np.allclose(r.origin, f["origin"]) and abs(r.deviation - f["deviation"]) < 1e-6
            p = np.array([q[1:] for q in rows if q[0] == r.k])
            plane = np.stack([r.u, r.v])
            assert np.allclose(plane @ plane.T, np.eye(2)) and r.u[2] == 0 and r.v[2] > 0 and max(r.u, key=abs) > 0
            assert np.abs((p - r.origin) @ np.cross(*plane)).max() <= 0.03


def test_states_and_split(spark):
    s = spark.createDataFrame([(1, "a", "completed"), (1, "b", "completed"), (2, "c", "failed"), (2, "d", "completed"), (3, "e", "waiting")], "run int, item string, state string")
    assert {r.run: r.status for r in S.roll_up(s, "run").collect()} == {1: "complete", 2: "partial", 3: "running"}
    g = spark.range(1000).select((F.col("id") % 50).alias("g")).withColumn("s", S.grouped_split(F.col("g"), {"train": 7, "test": 3}))
    assert g.groupBy("g").agg(F.count_distinct("s").alias("n")).agg(F.max("n")).first()[0] == 1


def test_missing_outputs(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    have = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "item string, file string")
    assert [tuple(r) for r in S.missing_outputs(items, have, ["x", "y"]).collect()] == [("b", ["y"])]


def test_parsed_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0), (float("inf"), 0.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    assert [r[0] is not None for r in df.select(B.parsed(B.Box.at())).collect()] == [True, False, False, False]


def test_refined_pose_keeps_the_photo():
    import numpy as np

    from quoin.operators import policy as L

    same, centres = np.eye(3), np.array([[0, 0], [100, 0], [0, 100.0]])
    told = lambda h, c=centres: tuple(L.keeps_pose(np.array(h, float), same, (640, 480), c).values())
    assert told(same) == (True, True, True)
    assert told([[-1, 0, 0], [0, 1, 0], [0, 0, 1]]) == (True, False, False)
    assert told([[1, 0, 0], [0, 1, 0], [-0.01, 0, 1]])[0] is False
    assert told([[1, 0, 29], [0, 1, 0], [0, 0, 1]])[2] and not told([[1, 0, 31], [0, 1, 0], [0, 0, 1]])[2]
    assert not told([[1, 0, 5], [0, 1, 0], [0, 0, 1]], centres / 10)[2] and not told([[1, 0, 1], [0, 1, 0], [0, 0, 1]], centres[:1])[2]


def test_ring_containment_of_touching_and_crossing_quadrangles():
    import numpy as np

    notch = np.array([[0, 0], [10, 0], [10, 10], [6, 10], [6, 4], [4, 4], [4, 10], [0, 10]], float)
    box = lambda x0, y0, x1, y1: np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    assert K.inside_ring(box(0, 0, 4, 10), notch) and K.inside_ring(box(0, 0, 10, 4), notch)
    assert not K.inside_ring(box(3, 3, 7, 5), notch) and not K.inside_ring(box(-1, 0, 3, 3), notch)
    assert K.inside_ring(box(-0.02, 0, 3, 3), notch, 0.03) and not K.inside_ring(box(-0.05, 0, 3, 3), notch, 0.03)
    assert K.inside_ring(box(0, 0, 4, 10), notch[::-1])
    assert len(K.clean_ring(np.array([[0, 0], [1, 0], [1, 0], [1, 1], [0, 0]], float))) == 3
