"""Column expressions for vectors, projections, bearings, percentiles and hold-out cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import finite

#: The hold-out grid and its rule, and the limits of projections.
HOLDOUT_GRID = (8, 4)
HOLDOUT_MODULUS = 3
POLE = 1e-12
STRICT_POLE = 1e-9
MIN_NORM = 1e-12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v scaled to length one; null for vectors that are not finite or shorter than MIN_NORM."""
    ok = v.isNotNull() & F.forall(v, lambda x: finite(x)) & (norm(v) >= MIN_NORM)
    return F.when(ok, F.transform(v, lambda x: x / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def project(x: Column, y: Column, h: Sequence[float], pole: float = POLE) -> Column:
    """Homography (nine numbers by row) of a point as a struct; null where it goes to infinity."""
    u, v, w = (x * h[i] + y * h[i + 1] + h[i + 2] for i in (0, 3, 6))
    return F.when(finite(u, v, w) & (F.abs(w) > pole), F.struct((u / w).alias("x"), (v / w).alias("y")))


def pixel(v: Column) -> Column:
    """Nearest pixel: halves go up."""
    return F.floor(v + 0.5)


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Pixel-centre convention: the image reaches from -0.5 to its size less 0.5."""
    return finite(x, y) & (x >= -0.5) & (y >= -0.5) & (x < width - 0.5) & (y < height - 0.5)


def to_pixels(n: Column, size: Column, offset: Column) -> Column:
    """Normalised coordinate in [-1, 1] (edges) to a pixel of a crop that begins at offset."""
    return (n + 1) * size / 2 - 0.5 + offset


def holdout_cell(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Cell column, cell row and whether the cell is held out; null for points outside the image, which are on neither side."""
    within = inside(x, y, width, height)
    cell = lambda v, size, n: F.when(within, F.least(F.floor((v + 0.5) / size * n), F.lit(n - 1)))
    cx, cy = cell(x, width, HOLDOUT_GRID[0]), cell(y, height, HOLDOUT_GRID[1])
    return cx, cy, F.pmod(cx + cy, F.lit(HOLDOUT_MODULUS)) == 0


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def signed_area(points: Column) -> Column:
    """Shoelace formula over an array of structs x, y (ring not closed)."""
    n = F.size(points)
    term = lambda p, i: (lambda q: p["x"] * q["y"] - q["x"] * p["y"])(F.get(points, F.pmod(i + 1, n)))
    return F.aggregate(F.transform(points, term), F.lit(0.0), lambda s, x: s + x) / 2


def nearest_rank(column: str, q: float) -> Column:
    """Aggregate: element ceil(q n) of the ordered values with what is not finite as infinity; null if it hits that."""
    v = f"CASE WHEN {column} IS NULL OR isnan({column}) OR abs({column}) = double('Infinity') THEN double('Infinity') ELSE {column} END"
    got = F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {v})")
    return F.when(got < float("inf"), got)


def linear_percentile(v: Column, q: float) -> Column:
    return F.percentile(v, q)
