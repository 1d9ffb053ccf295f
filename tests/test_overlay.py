"""Overlay of polygons against counts of pixels and known shapes."""

import math
import random

import numpy as np
import pytest

from quoin.operators import overlay as O
from quoin.operators.kernels import area

box = lambda x0, y0, x1, y1: np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)


def parity(p, rings):
    """Which points are in rings by the even-odd rule."""
    odd = np.zeros(len(p), dtype=int)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
            if ay != by:
                spans = (ay > p[:, 1]) != (by > p[:, 1])
                odd += spans & (ax + (p[:, 1] - ay) * (bx - ax) / (by - ay) > p[:, 0])
    return odd % 2 == 1


def held(p, polygons):
    out = np.zeros(len(p), dtype=bool)
    for outer, holes in polygons:
        out |= parity(p, [outer, *holes])
    return out


def star(rng, n, x, y, size):
    return np.array([(x + r * math.cos(a), y + r * math.sin(a)) for a, r in sorted((2 * math.pi * (k + rng.random()) / n, size * rng.uniform(0.3, 1)) for k in range(n))])


@pytest.mark.parametrize("seed", range(12))
def test_random_polygons_as_by_pixels(seed):
    rng = random.Random(seed)
    lattice = seed % 3 == 0  # corners on a coarse lattice: edges shared in part, corners on edges
    snap = (lambda r: np.round(r * 2) / 2) if lattice else (lambda r: r)
    polygons = []
    for _ in range(rng.randrange(2, 7)):
        x, y = rng.uniform(-4, 4), rng.uniform(-4, 4)
        rings = [snap(star(rng, rng.randrange(3, 12), x, y, rng.uniform(1, 5)))]
        if rng.random() < 0.5:
            rings.append(snap(star(rng, 5, x + rng.uniform(-2, 2), y, rng.uniform(0.3, 2))))
        if rng.random() < 0.3:
            rings[0] = snap(np.array([(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(6)]))  # crosses itself
        polygons.append([r for r in rings if len(np.unique(r, axis=0)) > 2] or [box(0, 0, 1, 1)])
    g = np.stack(np.meshgrid(np.arange(-10, 10, 0.07) + 0.0131, np.arange(-10, 10, 0.07) + 0.0177), axis=-1).reshape(-1, 2)
    m = np.stack([parity(g, p) for p in polygons], axis=1)
    for found, want in ((O.union(polygons), m.any(axis=1)), (O.intersection(polygons), m.all(axis=1)), (O.difference(polygons[0], polygons[1:]), m[:, 0] & ~m[:, 1:].any(axis=1))):
        assert (held(g, found) != want).sum() <= 2  # points within the grid's step of an edge
        assert abs(O.size(found) - want.sum() * 0.07**2) < 0.5 + 0.02 * want.sum() * 0.07**2
        for outer, holes in found:
            assert area(outer) > 0 and all(area(h) < 0 for h in holes) and O.simple(outer)


def test_shared_edges_touching_corners_and_holes():
    one = lambda *p: O.union([[x] for x in p])
    assert [len(o) for o, _ in one(box(0, 0, 1, 1), box(1, 0.25, 2, 0.75))] == [8]
    assert [len(o) for o, _ in one(box(0, 0, 1, 1), box(1, 0, 2, 1), box(0, 1, 2, 2))] == [4]
    assert [O.size([p]) for p in one(box(0, 0, 2, 2), box(2, 2, 3, 3))] == [4.0, 1.0]  # a corner does not join
    ring = one(box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 1, 1, 2), box(2, 1, 3, 2))
    assert len(ring) == 1 and [round(area(h), 9) for h in ring[0][1]] == [-1.0] and round(O.size(ring), 9) == 8.0
    pinched = O.difference([box(0, 0, 4, 4)], [[np.array([[0, 2], [1, 1], [2, 2], [1, 3]], float)]])
    assert len(pinched) == 1 and len(pinched[0][1]) == 1 and round(O.size(pinched), 9) == 14.0
    cut = O.difference([box(0, 0, 3, 1)], [[box(1, -1, 2, 2)]])
    assert [round(O.size([p]), 9) for p in cut] == [1.0, 1.0]
    assert O.intersection([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]]) == [] and O.difference([box(0, 0, 1, 1)], [[box(-1, -1, 2, 2)]]) == []
    inner = O.union([[box(0, 0, 9, 9), box(1, 1, 8, 8)], [box(3, 3, 6, 6)]])  # an island in a hole
    assert [(round(area(o), 6), len(h)) for o, h in inner] == [(81.0, 1), (9.0, 0)]


def test_edges_that_meet_but_for_rounding():
    """Triangles of a fan turned by an odd angle: inner edges go, though their ends are rounded apart."""
    c, s = math.cos(0.3), math.sin(0.3)
    turn = lambda p: np.asarray(p) @ np.array([[c, s], [-s, c]]) + np.array([691_000.0, 5_336_000.0])
    corners = [(0, 0), (10, 0), (10, 3), (10, 7), (10, 10), (0, 10), (0, 5)]
    fan = [[turn(np.array([(4, 4), corners[i], corners[(i + 1) % 7]], float)) + 1e-9 * i] for i in range(7)]
    found = O.union(fan)
    assert len(found) == 1 and not found[0][1] and O.size(found) == pytest.approx(100, abs=1e-3) and len(found[0][0]) <= 8
    halves = [[turn(box(0, 0, 5, 4))], [turn(np.array([[5, 1], [9, 1], [9, 3], [5, 3]], float))]]
    assert O.size(O.union(halves)) == pytest.approx(28, abs=1e-4) and len(O.union(halves)) == 1


def test_repair_of_rings_that_cross():
    bow = np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)
    assert sorted(round(area(o), 6) for o, _ in O.repaired(bow, [])) == [1.0, 1.0] and not O.simple(bow)
    out = O.repaired(box(0, 0, 4, 4), [box(3, 1, 5, 2), box(1, 1, 2, 2), box(1.5, 1, 2.5, 2)])  # over the edge; overlapping
    assert len(out) == 1 and len(out[0][1]) == 1 and O.size(out) == pytest.approx(16 - 1 - 1.5)
    assert O.simple(box(0, 0, 1, 1)) and not O.simple(np.array([[0, 0], [1, 0], [2, 0]], float)) and not O.simple(np.array([[0, 0], [np.nan, 1], [1, 1]]))


def test_tables(spark):
    rings = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]
    rows = [("a", 1, rings(box(0, 0, 2, 2))), ("a", 2, rings(box(2, 0.5, 3, 1))), ("b", 1, rings([(0, 0), (2, 2), (2, 0), (0, 2)])), ("c", 1, rings(box(0, 0, 1, 1))), ("c", 2, rings(box(5, 5, 7, 7)))]
    df = spark.createDataFrame(rows, "wall_id string, ord int, rings array<array<struct<x: double, y: double>>>")
    got = {(r.wall_id, r.ring_id): r for r in O.wall_outlines(df).collect()}
    assert len(got["a", 0].points) == 8 and got["b", None].error == "ring is not simple"
    assert [got["c", i].points[0].x for i in (0, 1)] == [5.0, 0.0]
    less = {r.wall_id: (r.area, r.error) for r in O.overlay(df, "wall_id", "difference").where("part = 0").collect()}
    assert less == {"a": (4.0, None), "b": (1.0, None), "c": (1.0, None)}
