"""Guided tile matching against plain loops over pixels."""

import math
import random

import numpy as np
import pytest

from quoin.operators import guided as G

PAIR = "pair int, photo_w int, photo_h int, render_w int, render_h int, h array<double>, view_id string"
VIEW = [("u", 300, 200), ("v", 130, 70), ("empty", 300, 200)]


@pytest.fixture(scope="module")
def walls(spark):
    rng = random.Random(2)
    rows = {("u", x, y) for x in range(60, 200) for y in range(90, 170) if (x // 9 + y // 7) % 3} | {("v", rng.randrange(130), rng.randrange(70)) for _ in range(40)} | {("u", 299, 199), ("v", 0, 0)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "view_id string, x int, y int"), spark.createDataFrame(VIEW, "view_id string, w int, h int")


def test_sums_count_pixels_of_any_crop(spark, walls):
    rows, pixels, views = walls
    rng = random.Random(1)
    crops = []
    for i in range(400):
        view, w, h = VIEW[rng.randrange(3)]
        x0, y0 = rng.randrange(w), rng.randrange(h)
        crops.append((i, view, x0, y0, rng.randrange(x0 + 1, w + 1), rng.randrange(y0 + 1, h + 1)))
    df = spark.createDataFrame(crops, "i int, view_id string, cx0 int, cy0 int, cx1 int, cy1 int")
    sums = G.summed_areas(pixels.repartition(3), views)
    got = {r.i: r.n for r in G.wall_pixels(df, sums, ["i"]).collect()}
    assert got == {i: sum(v == view and x0 <= x < x1 and y0 <= y < y1 for v, x, y in rows) for i, view, x0, y0, x1, y1 in crops}


def plain_tiles(w, h):
    cut = lambda n, size: [0] if n <= size else sorted({*range(0, n - size + 1, size - 300), n - size})
    return [(x, y, min(x + 1200, w), min(y + 1000, h)) for y in cut(h, 1000) for x in cut(w, 1200)]


def plain_crop(box, h, render, wall):
    h = np.array(h).reshape(3, 3)
    h = h / np.linalg.norm(h)
    x0, y0, x1, y1 = (v - 0.5 for v in box)
    p = np.array([[x0, y0, 1], [x1, y0, 1], [x1, y1, 1], [x0, y1, 1]]) @ h.T
    if not ((p[:, 2] > 1e-12).all() or (p[:, 2] < -1e-12).all()):
        return G.REASONS[0], None
    q = p[:, :2] / p[:, 2:]
    span = np.ptp(q, axis=0)
    area = abs(sum(q[i, 0] * q[(i + 1) % 4, 1] - q[i, 1] * q[(i + 1) % 4, 0] for i in range(4))) / 2
    if (span < 1).any() or area < 1:
        return G.REASONS[2], None
    lo, hi = np.maximum(q.min(axis=0) - 0.1 * span, -0.5), np.minimum(q.max(axis=0) + 0.1 * span, np.array(render) - 0.5)
    if (hi - lo < 32).any():
        return G.REASONS[3], None
    crop = (*(int(math.floor(v + 0.5)) for v in lo), *(int(math.ceil(v + 0.5)) for v in hi))
    return (None if any(crop[0] <= x < crop[2] and crop[1] <= y < crop[3] for x, y in wall) else G.REASONS[4]), crop


@pytest.fixture(scope="module")
def planned(spark, walls):
    rng = random.Random(5)
    pairs = []
    for i in range(40):
        view, w, h = VIEW[i % 3]
        pw, ph = rng.choice([700, 1500, 2600]), rng.choice([600, 1300])
        hom = [w / pw * rng.uniform(0.5, 2), rng.uniform(-0.02, 0.02), rng.uniform(-w / 3, w / 3), rng.uniform(-0.02, 0.02), h / ph * rng.uniform(0.5, 2), rng.uniform(-h / 3, h / 3), rng.choice([0.0, 1e-4, -1 / 900]), 0.0, 1.0]
        if i % 11 == 5:
            hom = [1e-5, 0.0, 50.0, 0.0, 1e-5, 50.0, 0.0, 0.0, 1.0]
        pairs.append((i, pw, ph, w, h, hom, view))
    df = G.plan_tiles(spark.createDataFrame(pairs, PAIR), walls[1], walls[2])
    return pairs, df, df.collect()


def test_all_reasons_as_by_plain_loops(planned, walls):
    pairs, df, rows = planned
    got = {(r.pair, r.x0, r.y0): r for r in rows}
    seen = set()
    for i, pw, ph, w, h, hom, view in pairs:
        for box in plain_tiles(pw, ph):
            reason, crop = plain_crop(box, hom, (w, h), [(x, y) for v, x, y in walls[0] if v == view])
            r = got.pop((i, box[0], box[1]))
            seen.add(reason)
            assert r.skip_reason == reason and (r.x1, r.y1) == box[2:]
            assert crop is None or (r.cx0, r.cy0, r.cx1, r.cy1) == crop
    assert not got and seen == {None, *G.REASONS} - {G.REASONS[1]}
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_at_infinity_are_named(spark, walls):
    huge = [1e300, 0.0, 0.0, 0.0, 1e300, 0.0, 0.0, 0.0, 1e-300]
    got = G.crops(spark.createDataFrame([(1, 700, 600, 300, 200, huge, "u")], PAIR), "pair").first()
    assert got.skip_reason in (G.REASONS[0], G.REASONS[1])


def test_matches_come_back_to_whole_images(spark, planned, walls):
    pairs, df, rows = planned
    rng = random.Random(8)
    wall = {(v, x, y) for v, x, y in walls[0]}
    raw, failed = [], []
    for r in rows:
        if r.skip_reason is None and rng.random() < 0.15:
            failed.append((r.pair, r.name))
        for k in range(60):
            raw.append((r.pair, r.name, k, *(rng.choice([rng.uniform(-1, 1), 0.001 * rng.randrange(3)]) for _ in range(4)), rng.choice([0.1, 0.3, 0.9, float("nan"), rng.random()])))
    out, report = G.guided_matches(df, spark.createDataFrame(raw, "pair int, name string, ord int, ax double, ay double, bx double, by double, overlap double"), spark.createDataFrame(failed, "pair int, name string"), walls[1])
    by, best, before = {(r.pair, r.name): r for r in rows}, {}, {}
    for p, name, k, ax, ay, bx, by_, overlap in raw:
        r = by[p, name]
        if r.skip_reason or (p, name) in failed or not overlap >= 0.2:
            continue
        px, py = (ax + 1) * (r.x1 - r.x0) / 2 - 0.5 + r.x0, (ay + 1) * (r.y1 - r.y0) / 2 - 0.5 + r.y0
        rx, ry = (bx + 1) * (r.cx1 - r.cx0) / 2 - 0.5 + r.cx0, (by_ + 1) * (r.cy1 - r.cy0) / 2 - 0.5 + r.cy0
        if not (r.cx0 - 0.5 <= rx < r.cx1 - 0.5 and r.cy0 - 0.5 <= ry < r.cy1 - 0.5 and px < r.x1 - 0.5 and py < r.y1 - 0.5) or rx >= r.render_w - 0.5 or ry >= r.render_h - 0.5:
            continue
        if (r.view_id, math.floor(rx + 0.5), math.floor(ry + 0.5)) not in wall:
            continue
        before[p, name] = before.get((p, name), 0) + 1
        key = (p, math.floor(px + 0.5), math.floor(py + 0.5))
        rank = (-overlap, int(name.split("_")[1]), k)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, name)
    got = sorted((r.pair, r.name, r.ord, r.overlap) for r in out.collect())
    assert got == sorted((key[0], name, rank[2], -rank[0]) for key, (rank, name) in best.items()) and got
    after = {}
    for key, (_, name) in best.items():
        after[key[0], name] = after.get((key[0], name), 0) + 1
    for r in report.collect():
        state = "skipped" if by[r.pair, r.name].skip_reason else "failed" if (r.pair, r.name) in failed else "completed"
        assert r.status == state
        assert (r.raw_matches, r.kept_before, r.kept_after) == ((60, before.get((r.pair, r.name), 0), after.get((r.pair, r.name), 0)) if state == "completed" else (None,) * 3)
    for r in G.overall(report).collect():
        mine = [x for x in rows if x.pair == r.pair]
        kept = sum(after.get((x.pair, x.name), 0) for x in mine)
        assert r.tiles == len(mine) and r.kept_after == kept
        assert r.status == ("no_matches" if not kept else "complete" if r.completed == r.tiles else "partial")
