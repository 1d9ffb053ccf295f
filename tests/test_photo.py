"""One photo to 3D for several photos at once: every status with its reason."""

import pytest
from test_mapping import CAMERA, ONE, SQUARE, scene_pixels

from quoin.operators import photo as P

CANDIDATE = "photo_id string, candidate_id string, ord int, building_id string, wall_id string, view_name string, score double, gate_passed boolean, vote_accepted boolean, h array<double>, camera array<double>, origin array<double>, u array<double>, v array<double>, render_w double, render_h double"
BOX = [("window", 20.0, 20.0, 40.0, 40.0), ("door", 63.0, 50.0, 75.0, 75.0), ("window", 80.0, 80.0, 90.0, 90.0)]


def shifted(dx):
    return [1.0, 0.0, dx, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def candidate(photo, n, view, score, wall="A", h=ONE, gate=True, vote=True, origin=(0.0, 0.0, 0.0), building="b"):
    return (photo, f"c{n}", n, building, wall, view, score, gate, vote, h, CAMERA, None if origin is None else list(origin), [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], 121.0, 121.0)


CANDIDATES = [
    candidate("good", 1, "front", 0.8), candidate("good", 2, "side", 0.75), candidate("good", 3, "front", 0.5, wall="B"),
    candidate("close", 1, "front", 0.8), candidate("close", 2, "side", 0.79), candidate("close", 3, "front", 0.76, wall="B"),
    candidate("alone", 1, "front", 0.8), candidate("alone", 2, "side", 0.7, gate=False),
    candidate("apart", 1, "front", 0.8), candidate("apart", 2, "side", 0.7, h=shifted(12.0)),
    candidate("none", 1, "front", 0.8, gate=False), candidate("none", 2, "front", 0.9, vote=False),
    candidate("empty", 1, "front", 0.8), candidate("empty", 2, "side", 0.7),
    candidate("broken", 1, "front", 0.9), candidate("curved", 1, "front", 0.9, origin=None), candidate("curved", 2, "side", 0.8, origin=None),
]


@pytest.fixture(scope="module")
def tables(spark):
    ids = ["good", "close", "alone", "apart", "none", "empty", "broken", "curved", "unmatched"]
    photos = spark.createDataFrame([(i, 121.0, 121.0, "photo cannot be read" if i == "broken" else None) for i in ids], "photo_id string, photo_w double, photo_h double, error string")
    det = [(i, n + 1, *b) for i in ids for n, b in enumerate(BOX)]
    det = [(i, n, k, *((0.0, *b[1:]) if i == "empty" else b)) for i, n, k, *b in det]
    pixels = [("b", view, x, y, o) for view in ("front", "side", "back") for _, x, y, o in scene_pixels()]
    rings = [(SQUARE[0], 0, [(float(x), float(y)) for x, y in SQUARE[1]])]
    return (
        photos, spark.createDataFrame(CANDIDATES, CANDIDATE), spark.createDataFrame(det, "photo_id string, ord int, class string, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(rings, "wall_id string, ring_id int, points array<struct<x: double, y: double>>"), spark.createDataFrame(pixels, "building_id string, view_name string, x int, y int, object_index int"),
        spark.createDataFrame([("b", 0, "WallSurface", "A"), ("b", 1, "Window", "A"), ("b", 2, "WallSurface", "B")], "building_id string, object_index int, kind string, wall_id string"),
    )


def test_every_photo_has_its_status_and_reason(tables):
    statuses, mapped = P.locate(*tables)
    got = {r.photo_id: r for r in statuses.collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {
        "good": ("mapped", "automatic_checks_passed"), "close": ("needs_review", "ambiguous_candidates"), "alone": ("needs_review", "insufficient_cross_view_confirmation"),
        "apart": ("needs_review", "views_disagree_on_world_position"), "none": ("needs_review", "no_candidate_passed_geometry"), "empty": ("no_detections_mapped", "automatic_checks_passed"),
        "broken": ("failed", "photo cannot be read"), "curved": ("needs_review", "wall_not_supported_by_planar_reader"), "unmatched": ("needs_review", "no_candidate_passed_geometry"),
    }
    good = got["good"]
    assert (good.selected_id, good.building_id, good.wall_id, good.view_name, good.mapped_count, good.rejected_count, good.comparisons) == ("c1", "b", "A", "front", 2, 1, 1)
    assert good.margin == pytest.approx(0.3) and got["close"].selected_id is None and got["empty"].mapped_count == 0
    assert {r.photo_id for r in mapped.select("photo_id").distinct().collect()} == {"good", "empty"}


def test_views_that_would_confirm_a_clear_candidate(spark, tables):
    views = spark.createDataFrame([("b", v, "A", n) for v, n in (("front", 900), ("side", 800), ("back", 700), ("top", 10))] + [("b", "back", "B", 650), ("z", "back", "A", 999)], "building_id string, view_name string, wall_id string, pixels long")
    got = sorted((r.photo_id, r.building_id, r.wall_id, r.view_name, r.choice) for r in P.wanted_views(tables[1], views).collect())
    assert got == sorted([("alone", "b", "A", "back", 1), ("broken", "b", "A", "side", 1), ("broken", "b", "A", "back", 2)])
