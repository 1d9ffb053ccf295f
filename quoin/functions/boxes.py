"""Column expressions over axis-parallel boxes (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grouping and validation rules.
SAME_IOU = 0.45
NESTED_IOS = 0.90
NESTED_MIN_AREA_RATIO = 0.25
NESTED_CENTRE = 0.30
EDGE_MARGIN = 12.0
CATEGORIES = ("window", "door")
SPACE_AROUND = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


class Box:
    """The four columns of a box, by prefix (`a.` or `a_`) or as fields of a struct column."""

    def __init__(self, x0: Column, y0: Column, x1: Column, y1: Column):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1

    @classmethod
    def at(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def of(cls, s: Column) -> Box:
        return cls(*(s[c] for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return i / F.greatest(a.area + b.area - i, F.lit(1e-12))


def same_opening(a: Box, b: Box) -> Column:
    """Strictly more than SAME_IOU, or one nested in the other around the same centre."""
    i, small, large = intersection(a, b), F.least(a.area, b.area), F.greatest(a.area, b.area)
    near = lambda p0, p1, q0, q1, side: F.abs((p0 + p1) / 2 - (q0 + q1) / 2) <= NESTED_CENTRE * side
    nested = (
        (small > 0) & (F.try_divide(i, small) >= NESTED_IOS) & (F.try_divide(small, large) >= NESTED_MIN_AREA_RATIO)
        & near(a.x0, a.x1, b.x0, b.x1, F.greatest(a.width, b.width)) & near(a.y0, a.y1, b.y0, b.y1, F.greatest(a.height, b.height))
    )
    return (iou(a, b) > SAME_IOU) | nested


def finite(*cs: Column) -> Column:
    """All are numbers, neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in cs:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def parsed(b: Box) -> Column:
    """The box as a struct if it is finite and of positive size, else null."""
    ok = finite(b.x0, b.y0, b.x1, b.y1) & (b.x1 > b.x0) & (b.y1 > b.y0)
    return F.when(ok, F.struct(b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1")))


def category(c: Column) -> Column:
    """Category without outer white space of any kind, in lower case, without final dots."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, SPACE_AROUND, "")), r"\.+\z", "")


def to_full(local: Box, tile: Box, width: Column, height: Column, margin: float = EDGE_MARGIN) -> Column:
    """A tile's box in image coordinates: clamped to the tile; null if empty or if it touches an internal cut."""
    w, h = tile.width, tile.height
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    x0, y0, x1, y1 = clamp(local.x0, w), clamp(local.y0, h), clamp(local.x1, w), clamp(local.y1, h)
    cut = (
        ((tile.x0 > 0) & (x0 <= margin)) | ((tile.y0 > 0) & (y0 <= margin))
        | ((tile.x1 < width) & (x1 >= w - margin)) | ((tile.y1 < height) & (y1 >= h - margin))
    )
    ok = (x1 > x0) & (y1 > y0) & ~cut
    return F.when(ok, F.struct((x0 + tile.x0).alias("x0"), (y0 + tile.y0).alias("y0"), (x1 + tile.x0).alias("x1"), (y1 + tile.y0).alias("y1")))
