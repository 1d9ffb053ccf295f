"""Operators do the whole job: nothing capped, nothing left out."""

import numpy as np
from pyspark.sql import functions as F

from quoin.operators import kernels as K
from quoin.operators import matching as M
from quoin.operators import policy as L
from quoin.operators import state as S
from quoin.plans import catalogue, views

SF = "/root/testdata/sf0.001"


def test_least_distance_of_checks_to_controls_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, (scale, n) in enumerate([(1000.0, 300), (1.0, 200), (1e5, 2), (0.0, 5), (50.0, 1)]):
        sides = {r: rng.uniform(-scale, scale, (n, 2)) + (0 if r == "check" else k % 2 * 5 * scale) for r in ("check", "control")}
        rows += [(k, r, *map(float, p), 0.1) for r, ps in sides.items() for p in ps]
        want[k] = float(np.linalg.norm(sides["check"][:, None] - sides["control"][None], axis=2).min())
    rows += [(9, "control", 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "k int, role string, px double, py double, error_m double")
    got = {r.k: r.apart for r in L.calibration(df, "k").collect()}
    assert got.pop(9) is None and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_calibration_takes_every_match(spark):
    all_ = views.matches(spark, SF).groupBy("cand").count().where("count > 80")
    q = catalogue.QUERIES["calibration_quality"](spark, SF).collect()
    e = catalogue._errors(spark, SF).where("ord % 40 <> 0").selectExpr("cand", "error / 100 AS e").groupBy("cand").agg({"e": "collect_list"}).collect()
    want = {r[0]: float(np.sqrt(np.mean(np.square(r[1])))) for r in e}
    assert all_.count() and {r.cand for r in q} == want.keys() and all(abs(r.rmse_m - want[r.cand]) < 1e-6 for r in q)


EYE = [float(i % 5 == 0) for i in range(16)]


def agreed(spark, rows, depth=10.0, pixels=True):
    """Rows (view, x shift of the homography, gate_passed); the first is selected. One pixel is one metre."""
    c = [("r", n, "1", "w", n, ok, True, [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], EYE, [0.0, 0.0, depth], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]) for n, dx, ok in rows]
    c = spark.createDataFrame(c, "run string, candidate_id string, building_id string, wall_id string, view_name string, gate_passed boolean, vote_accepted boolean, " + ", ".join(f"{n} array<double>" for n in ("h", "camera", "origin", "u", "v")))
    p = spark.range(100 * 100 * 3).selectExpr("'1' AS building_id", "element_at(array('a', 'b', 'c'), cast(id % 3 + 1 AS int)) AS view_name", "floor(id / 3) % 100 AS x", "floor(id / 300) AS y", "'w' AS wall_id")
    return M.view_agreement(c.limit(1).select("run", "candidate_id"), c, p if pixels else p.where("x < 20"), (100, 100), "run").collect()


def test_views_of_a_wall_must_agree(spark):
    why = lambda *a, **k: [(r.passed, r.comparisons, r.reason) for r in agreed(spark, *a, **k)]
    assert why([("a", 0.0, True), ("b", 0.0, True)]) == [(True, 1, None)]
    assert why([("a", 0.0, True), ("b", 1.0, True)]) == [(False, 1, "views_disagree_on_world_position")]
    assert why([("a", 0.0, True), ("b", 0.0, True), ("c", 1.0, True)]) == [(False, 2, "views_disagree_on_world_position")]
    assert why([("a", 0.0, True), ("b", 0.0, False)]) == [(False, 0, "insufficient_cross_view_confirmation")]
    assert why([("a", 0.0, True), ("b", 0.0, True)], pixels=False) == [(False, 1, "views_disagree_on_world_position")]
    assert why([("a", 0.0, True), ("b", 0.0, True)], depth=-1.0) == [(False, 1, "invalid_wall_projection")]


def test_states_of_batches_runs_and_renders(spark):
    b = spark.createDataFrame([(1, "success"), (1, "failed"), (2, "success"), (3, "pending"), (3, "failed")], "run int, state string")
    assert {r.run: r.status for r in S.batch_outcome(b, "run").collect()} == {1: "completed_with_errors", 2: "completed", 3: "running"}
    r = [(1, True, None, "c", None, 3), (2, True, None, "c", None, 0), (3, True, None, None, None, None), (4, True, None, "c", "x", None), (5, False, None, None, None, None), (6, False, "x", None, None, None)]
    got = S.mapping_status(spark.createDataFrame(r, "run int, finished boolean, error string, selected_id string, mapping_error string, mapped_count int")).orderBy("run").collect()
    assert [x.status for x in got] == ["mapped", "no_detections_mapped", "needs_review", "needs_review", "running", "failed"]
    log = [("a", i, s) for i, s in enumerate(S.RENDER_STAGES)] + [("b", 0, "loading_model"), ("b", 1, "rendering_views"), ("b", 2, "failed"), ("c", 0, "loading_model"), ("d", 0, "failed")]
    got = {x.k: (x.stage, x.status) for x in S.render_state(spark.createDataFrame(log, "k string, seq int, stage string"), "k").collect()}
    assert got == {"a": ("complete", "complete"), "b": ("rendering_views", "failed"), "c": ("loading_model", "running"), "d": (None, "failed")}


def test_names_sizes_sources_and_order(spark):
    names = spark.createDataFrame([(x,) for x in ("4906970", "a b", "", ".", "..", "a/b", "a\\b", "a:b", "a*", "a.", "a ", None)], "n string")
    assert [r[0] for r in names.select(L.folder_name(F.col("n"))).collect()] == [True, True] + [False] * 10
    sizes = spark.createDataFrame([(2.0, 2.0), (1.0, 5.0), (2.5, 3.0), (float("nan"), 3.0), (None, 3.0)], "w double, h double")
    assert [r[0] for r in sizes.select(L.image_size(F.col("w"), F.col("h"))).collect()] == [True, False, False, False, False]
    renders = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "source_gml string, source_sha256 string")
    models = spark.createDataFrame([("a", "1"), ("b", "2")], "source_gml string, source_sha256 string")
    assert [r.reject_reason for r in L.unchanged_source(renders, models).orderBy("source_gml").collect()] == [None, "source_model_changed", "source_model_changed"]
    t = spark.createDataFrame([("g", "a", 1), ("g", "b", 9), ("g", "c", 9)], "g string, building_id string, size_bytes long")
    assert [r.building_id for r in L.task_order(t, "g").orderBy("place").collect()] == ["b", "c", "a"]


def test_homography_is_found_among_many_outliers():
    h = np.array([[1.02, 0.03, 12], [-0.02, 0.98, 30], [2e-5, -1e-5, 1]])
    corners = np.array([[0, 0], [1000, 0], [1000, 600], [0, 600]], float)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a = rng.uniform([0, 0], [1000, 600], (300, 2))
        b = K.transform(h, a) + rng.normal(0, 0.1, a.shape)
        b[42:] = rng.uniform([0, 0], [1000, 700], (258, 2))
        got, inliers = K.ransac(a, b)
        assert np.abs(K.transform(got, corners) - K.transform(h, corners)).max() <= 1.0 and inliers[:42].all()
