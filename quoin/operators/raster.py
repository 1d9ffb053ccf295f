"""Visibility rasters as tables of pixels, orthographic cameras, and the mapping of boxes to walls."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import boxes as B
from quoin.functions import numeric as N

#: Fixed values of the mapping policy.
BORDER = 1e-6
POLE = 1e-12
MIN_AREA = 1e-6
MIN_RAY_COSINE = 1e-4
SAMPLES, INSET = 5, 0.10
MIN_SAME, MAX_OTHER = 0.80, 0.05
Z_TIE = 1e-8
REJECTS = (
    "unsupported_detection_class", "invalid_detection_box", "box_outside_photo", "box_touches_photo_border_may_be_incomplete", "projective_pole_crosses_detection",
    "mapped_box_outside_render_image", "invalid_ray_plane_intersection", "mapped_polygon_is_degenerate", "mapped_box_not_fully_inside_wall_outer_boundary",
)
OWN = 0
"""What stands for all allowed objects where a raster only tells these from others."""


def cover(triangles: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels that triangles cover, with depth. triangles (view_id, tri_id, object_index, and ax, ay, az .. cz in pixels).

    Only a triangle's own box of pixels is exploded; barycentric coordinates decide."""
    lo = lambda c: F.greatest(F.lit(0.0), F.ceil(F.least(f"a{c}", f"b{c}", f"c{c}"))).cast("int")
    hi = lambda c, n: F.least(F.lit(n - 1.0), F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}"))).cast("int")
    t = triangles.withColumns({"_x0": lo("x"), "_x1": hi("x", width), "_y0": lo("y"), "_y1": hi("y", height)}).where("_x0 <= _x1 AND _y0 <= _y1")
    area = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    t = t.withColumn("_area", area).where(F.abs("_area") > 1e-12)
    t = t.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    edge = lambda p, q: ((F.col(f"{q}x") - F.col(f"{p}x")) * (F.col("y") - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col("x") - F.col(f"{p}x"))) / F.col("_area")
    t = t.withColumns({"_wa": edge("b", "c"), "_wb": edge("c", "a"), "_wc": edge("a", "b")}).where(f"_wa >= -{Z_TIE} AND _wb >= -{Z_TIE} AND _wc >= -{Z_TIE}")
    depth = F.col("_wa") * F.col("az") + F.col("_wb") * F.col("bz") + F.col("_wc") * F.col("cz")
    return t.select("view_id", "x", "y", "tri_id", "object_index", depth.alias("depth"))


def zbuffer(covered: DataFrame) -> DataFrame:
    """For each pixel the nearest positive depth, the earlier triangle of equals; min_by combines map-side."""
    return covered.where("depth > 0").groupBy("view_id", "x", "y").agg(
        F.min_by(F.struct("object_index", "tri_id", "depth"), F.struct("depth", "tri_id")).alias("hit")).select("view_id", "x", "y", "hit.object_index", "hit.depth")


def visible_walls(pixels: DataFrame, objects: DataFrame) -> DataFrame:
    """Pixels of each wall in each view (openings count for their wall), with its objects; and its rank."""
    seen = pixels.join(objects.where("wall_id IS NOT NULL").select("object_index", "wall_id"), "object_index")
    out = seen.groupBy("view_id", "wall_id").agg(F.count("*").alias("pixels"), F.sort_array(F.collect_set("object_index")).alias("objects"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("pixels"), "wall_id")))


def at_pixel(points: DataFrame, pixels: DataFrame, x: str, y: str) -> DataFrame:
    """points (view_id, x, y) with the object and depth of their nearest pixel; -1 where there is none, as beside the image
    or for points that are not finite."""
    near = N.finite(F.col(x), F.col(y)) & (F.greatest(F.abs(F.col(x)), F.abs(F.col(y))) < 2.0**31 - 2)
    p = points.withColumns({f"_{n}": F.when(near, N.pixel(F.col(c))).cast("int") for n, c in (("x", x), ("y", y))})
    q = pixels.select("view_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "object_index", "depth")
    return p.join(q, ["view_id", "_x", "_y"], "left").withColumn("object_index", F.coalesce("object_index", F.lit(-1))).drop("_x", "_y")


def affine(m: Sequence[Sequence[float]], x: Column, y: Column, z: Column) -> Column:
    """Rows 0-2 of a 4x4 matrix applied to a point, as a struct."""
    return F.struct(*[(x * r[0] + y * r[1] + z * r[2] + r[3]).alias(n) for n, r in zip("xyz", m, strict=False)])


def inverse(m: Sequence[Sequence[float]]) -> list[list[float]]:
    """Inverse of a 4x4 affine matrix."""
    return np.linalg.inv(np.array(m, dtype=float)).tolist()


def ray_plane(px: Column, py: Column, pixel_to_local: Sequence[Sequence[float]], frame: dict[str, Sequence[float]]) -> Column:
    """Where the orthographic ray of a pixel meets a wall's plane: struct u, v, depth, x, y, z; null if there is no
    stable meeting in front of the camera. The frame (origin, u, v) is in local coordinates."""
    m = np.array(pixel_to_local, dtype=float)
    o, u, v = (np.array(frame[k], dtype=float) for k in ("origin", "u", "v"))
    n = np.cross(u, v)
    n = n / np.linalg.norm(n)
    d = m[:3, 2]
    den = float(d @ n)
    if np.linalg.norm(d) < 1e-12 or abs(den) / np.linalg.norm(d) < MIN_RAY_COSINE:
        return F.lit(None).cast("struct<u:double,v:double,depth:double,x:double,y:double,z:double>")
    p = [px * float(m[i, 0]) + py * float(m[i, 1]) + float(m[i, 3]) for i in range(3)]
    depth = ((float(o[0]) - p[0]) * float(n[0]) + (float(o[1]) - p[1]) * float(n[1]) + (float(o[2]) - p[2]) * float(n[2])) / den
    q = [p[i] + depth * float(d[i]) for i in range(3)]
    on = lambda a: (q[0] - float(o[0])) * float(a[0]) + (q[1] - float(o[1])) * float(a[1]) + (q[2] - float(o[2])) * float(a[2])
    return F.when(N.finite(depth) & (depth > 0), F.struct(on(u).alias("u"), on(v).alias("v"), depth.alias("depth"), *[c.alias(k) for k, c in zip("xyz", q, strict=True)]))


def wall_point(px: Column, py: Column, camera: Column, origin: Column, u: Column, v: Column) -> Column:
    """ray_plane with camera (sixteen numbers by row) and frame in columns: struct x, y, z, or null."""
    m = [[F.get(camera, F.lit(4 * i + j)) for j in range(4)] for i in range(4)]
    o, a, b = ([F.get(c, F.lit(i)) for i in range(3)] for c in (origin, u, v))
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    d = [m[i][2] for i in range(3)]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    den = dot(d, n)
    p = [px * m[i][0] + py * m[i][1] + m[i][3] for i in range(3)]
    depth = F.try_divide(dot([o[i] - p[i] for i in range(3)], n), den)
    affine_ = F.greatest(*[F.abs(m[3][j] - (1.0 if j == 3 else 0.0)) for j in range(4)]) <= 1e-12
    steep = (F.sqrt(dot(d, d)) >= 1e-12) & (F.abs(den) >= F.sqrt(dot(d, d)) * F.sqrt(dot(n, n)) * MIN_RAY_COSINE)
    return F.when(affine_ & steep & N.finite(depth) & (depth > 0), F.struct(*[(p[i] + depth * d[i]).alias(k) for i, k in enumerate("xyz")]))


def corners(b: B.Box) -> list[tuple[Column, Column]]:
    return [(b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1)]


def map_boxes(det: DataFrame, h: Sequence[float], photo: tuple[int, int], render: tuple[int, int], pixel_to_local: Sequence[Sequence[float]], frame: dict[str, Sequence[float]], ring: tuple[float, float, float, float], tolerance: float = 0.03) -> DataFrame:
    """det (id, class, box) mapped to a rectangular wall (ring: u0, v0, u1, v1), with the first reject_reason that applies.

    Walls of other outlines take the polygon kernels' `inside_ring` in the place of the rectangle test."""
    from . import samples as X

    m = np.array(pixel_to_local, dtype=float)
    o, u, v = (np.array(frame[k], dtype=float) for k in ("origin", "u", "v"))
    n, d = np.cross(u, v), m[:3, 2]
    n = n / np.linalg.norm(n)
    den = float(d @ n)
    steep = np.linalg.norm(d) >= 1e-12 and abs(den) / np.linalg.norm(d) >= MIN_RAY_COSINE
    (pw, ph), (u0, v0, u1, v1) = (float(x) for x in photo), ring
    by_row = np.array([[float(x) for x in h]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x0, y0, x1, y1 = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1"))
            with np.errstate(all="ignore"):
                cx, cy = np.stack([x0, x1, x1, x0], axis=1), np.stack([y0, y0, y1, y1], axis=1)
                w = cx * by_row[0, 6] + cy * by_row[0, 7] + by_row[0, 8]
                one_side = (~(w <= POLE)).all(axis=1) | (w < -POLE).all(axis=1)
                px, py = X.project(cx, cy, by_row)
                inside = ((px >= -0.5) & (py >= -0.5) & (px < render[0] - 0.5) & (py < render[1] - 0.5)).all(axis=1)
                p = [px * m[i, 0] + py * m[i, 1] + m[i, 3] for i in range(3)]
                depth = ((o[0] - p[0]) * n[0] + (o[1] - p[1]) * n[1] + (o[2] - p[2]) * n[2]) / den if steep else np.full(px.shape, np.nan)
                q = [p[i] + depth * d[i] - o[i] for i in range(3)]
                x, y = (q[0] * a[0] + q[1] * a[1] + q[2] * a[2] for a in (u, v))
                met = (np.isfinite(depth) & (depth > 0)).all(axis=1)
                area = np.zeros(len(x0))
                for i in range(4):
                    k = (i + 1) % 4
                    area = area + (x[:, i] * y[:, k] - x[:, k] * y[:, i])
                area = np.abs(area / 2)
                within = ((x >= u0 - tolerance) & (x <= u1 + tolerance) & (y >= v0 - tolerance) & (y <= v1 + tolerance)).all(axis=1)
                sound = np.isfinite(x0) & np.isfinite(y0) & np.isfinite(x1) & np.isfinite(y1) & (x1 > x0) & (y1 > y0)
                outside = (x0 < 0) | (y0 < 0) | (x1 > pw) | (y1 > ph)
                border = (x0 <= BORDER) | (y0 <= BORDER) | (x1 >= pw - BORDER) | (y1 >= ph - BORDER)
                known = pc.is_in(b.column("class"), pa.array(["window", "door", "ambiguous"])).to_numpy(zero_copy_only=False)
                tests = np.stack([~known, ~sound, outside, border, ~one_side, ~inside, ~met, area < MIN_AREA, ~within], axis=1)
                side = lambda i, j: np.sqrt((x[:, i] - x[:, j]) ** 2 + (y[:, i] - y[:, j]) ** 2)  # noqa: B023, E731
                width, height = (side(1, 0) + side(2, 3)) / 2, (side(3, 0) + side(2, 1)) / 2
            first = np.where(tests.any(axis=1), tests.argmax(axis=1), -1)
            uv = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 4, dtype=np.int32)), pa.StructArray.from_arrays([x.ravel(), y.ravel()], ["x", "y"]), mask=pa.array(~met))
            made = [pa.array(REJECTS).take(pa.array(first, mask=first < 0)), uv, *(pa.array(c, mask=~met) for c in (area, width, height))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "reject_reason", "uv", "area_m2", "width_m", "height_m"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in det.schema.fields)
    return det.mapInArrow(run, f"{fields}, reject_reason string, uv array<struct<x: double, y: double>>, area_m2 double, width_m double, height_m double")


def visibility(det: DataFrame, h: Sequence[float], pixels: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Shares of SAMPLES x SAMPLES points of each box on allowed objects and on others, and whether that supports it.

    det (key, view_id, box), pixels (view_id, x, y, object_index, depth), allowed (view_id, object_index)."""
    from . import samples as X

    shown = pixels.select("view_id", "x", "y", "object_index").join(allowed.select("view_id", "object_index").distinct().withColumn("_ok", F.lit(True)), ["view_id", "object_index"], "left")
    shown = shown.select("view_id", "x", "y", F.when(F.col("_ok"), OWN).when(F.col("object_index") >= 0, OWN + 1).otherwise(-1).alias("object_index"))
    nine = F.array(*[F.lit(float(v)) for v in h])
    out = X.shares(det.select(key, "view_id", "x0", "y0", "x1", "y1", nine.alias("h"), F.array(F.lit(OWN)).alias("mine")), shown, [key]).withColumnRenamed("middle", "centre")
    return out.withColumn("supported", F.col("centre") & (F.col("same_wall") >= MIN_SAME) & (F.col("other_surface") <= MAX_OTHER))


def view_directions() -> list[tuple[float, float]]:
    """Orbit and elevation of the eight views: straight ones level, diagonal ones raised."""
    return [(a, 0.0) for a in (0.0, 90.0, 180.0, 270.0)] + [(a, 22.0) for a in (45.0, 135.0, 225.0, 315.0)]


def shade(nx: Column, ny: Column, nz: Column, view: Sequence[float], light: Sequence[float]) -> tuple[Column, Column]:
    """Whether the front faces the viewer, and the brightness."""
    d = lambda v: nx * float(v[0]) + ny * float(v[1]) + nz * float(v[2])
    return d(view) < 0, F.lit(0.60) + 0.25 * F.abs(d(view)) + 0.15 * F.abs(d(light))


def integrity(pixels: DataFrame, view: str = "view_id", width: str = "w", height: str = "h") -> DataFrame:
    """Pixels of each view that break the raster's rules, and the first rule that is broken.

    A pixel lies in the image and comes once; it has an object exactly where it has a finite depth, and that is positive."""
    deep = N.finite(F.col("depth"))
    hit = F.coalesce(F.col("object_index") >= 0, F.lit(False))
    away = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.col(width)) | (F.col("y") >= F.col(height))
    by_pixel = pixels.groupBy(view, "x", "y").agg(F.count("*").alias("n"), F.bool_or(away).alias("away"), F.bool_or(deep != hit).alias("odd"), F.bool_or(deep & (F.col("depth") <= 0)).alias("behind"))
    out = by_pixel.groupBy(view).agg(F.count_if("away").alias("outside"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if("odd").alias("unmatched"), F.count_if("behind").alias("not_positive"))
    reason = F.when(F.col("outside") > 0, "pixel_outside_image").when(F.col("repeated") > 0, "pixel_repeated").when(F.col("unmatched") > 0, "depth_without_object_or_reverse").when(F.col("not_positive") > 0, "depth_not_positive")
    return out.withColumn("reject_reason", reason)
