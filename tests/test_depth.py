"""Depth buffers of tiles against one row for each covered pixel."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import depth as Z
from quoin.operators import raster as R

TRIANGLE = "view_id int, tri_id int, object_index int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
NAN = float("nan")


def soup(seed, n, size):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, z = rng.uniform(-20, 220), rng.uniform(-20, 150), rng.choice([5.0, rng.uniform(-2, 9)])
        rows.append((i % 3, i, i % 7, *(v for _ in range(3) for v in (float(round(x + rng.uniform(-size, size))), y + rng.uniform(-size, size), z + rng.uniform(0, 2) * (i % 2)))))
    return rows


@pytest.mark.parametrize("seed,n,size", [(1, 300, 15), (2, 40, 150), (3, 500, 4)])
@pytest.mark.parametrize("kept", [1, 256])
def test_same_pixels_as_row_by_row(spark, monkeypatch, seed, n, size, kept):
    monkeypatch.setattr(Z, "BUFFERS", kept)
    rows = soup(seed, n, size) + [(0, 900, 1, NAN, 0.0, 1.0, 9.0, 0.0, 1.0, 0.0, 9.0, 1.0), (0, 901, 1, 5.0, 5.0, 1.0, 9.0, 9.0, 1.0, 7.0, 7.0, 1.0), (0, 902, 1, 5.0, 5.0, -1.0, 90.0, 5.0, -1.0, 5.0, 90.0, -1.0)]
    df = spark.createDataFrame(rows, TRIANGLE).repartition(4)
    want = R.zbuffer(R.cover(df.where(~F.isnan("ax")), 200, 130).withColumn("depth", F.round("depth", 9)))
    key = lambda r: (r.view_id, r.x, r.y)
    got, want = ({key(r): (r.object_index, round(r.depth, 8)) for r in d.collect()} for d in (Z.visible(df, 200, 130, 9), want))
    assert got == want and got


def test_known_triangles(spark):
    """Two that cross: either is in front on its side; the order of rows does not matter."""
    rows = [(0, 1, 7, 0.0, 0.0, 2.0, 20.0, 0.0, 6.0, 0.0, 20.0, 2.0), (0, 2, 19, 0.0, 0.0, 4.0, 20.0, 0.0, 4.0, 0.0, 20.0, 4.0)]
    for order in (rows, rows[::-1]):
        got = {(r.x, r.y): r for r in Z.visible(spark.createDataFrame(order, TRIANGLE), 21, 21).collect()}
        assert got[4, 4].object_index == 7 and got[4, 4].depth == pytest.approx(2.8) and got[13, 3].object_index == 19 and (20, 20) not in got


def test_plan_has_no_row_for_a_covered_pixel(spark):
    df = spark.createDataFrame(soup(1, 5, 9), TRIANGLE)
    out = Z.buffers(df, 4000, 3000)
    assert out.count() <= 15 * 4 and Z.visible(df.limit(0), 40, 30).count() == 0
