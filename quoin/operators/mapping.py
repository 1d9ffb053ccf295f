"""Detections of many photos mapped to walls of any outline, with the first of ten reasons that rejects each.

A run is a photo with the view it was matched to: sizes, homography, camera, and the frame and id of its wall. All runs go
through one plan. Corners are projected and met with the wall's plane in columns; containment is a join of the mapped
quadrangles with the edges of the wall's rings, filed by bands of height, so that a quadrangle meets the edges beside it and
not the whole outline; visibility joins its sample points with the view's pixels. Keys of all joins are even: a wall that
many photos show is divided by bands and by quadrangles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import numeric as N
from quoin.runtime import stored

from . import raster as R
from . import samples as X

CLASSES = ("window", "door", "ambiguous")
WALL_KINDS = ("WallSurface", "Window", "Door")
TOLERANCE = 0.03
#: Fixed values of the containment rule: edges below the first cross product run side by side; ends give that much.
FLAT, ENDS = 1e-12, 1e-9
SINGULAR = 3 * 2.0**-52
OPEN = ("x0", "y0", "x1", "y1", "h", "view_id", "building_id")
"""What only detections need that no reason has rejected yet."""
BAND, CELL = 1.0, 4.0
"""Metres: the height in which edges are filed, and the side of the cells in which rings are."""
FEW = 64
"""Edges with which a ring is sent to each of its cells as a whole; one of more is met by bands."""
LOT = 1 << 19
"""Pairs of points and edges that are compared at once."""
#: The reasons in their order.
REASONS = (
    "unsupported_detection_class", "invalid_detection_box", "box_outside_photo", "box_touches_photo_border_may_be_incomplete", "projective_pole_crosses_detection",
    "mapped_box_outside_render_image", "invalid_ray_plane_intersection", "mapped_polygon_is_degenerate", "mapped_box_not_fully_inside_wall_outer_boundary", "mapped_box_not_visibly_supported_by_selected_wall",
)


def grown(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides. What is exploded from a small file is taken for small and would be sent through the
    driver, though it grows with the walls."""
    return df.hint("merge")


def _at(array: str, n: int) -> list[Column]:
    return [F.get(array, F.lit(i)) for i in range(n)]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def wall_hit(px: Column, py: Column) -> Column:
    """Where the ray of a render pixel meets the plane of the row's wall (camera: sixteen numbers by row; origin, u, v):
    struct x, y (on the wall), depth, and point; null without a stable meeting in front of the camera."""
    m = _at("camera", 16)
    o, u, v = (_at(c, 3) for c in ("origin", "u", "v"))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    d = [m[4 * i + 2] for i in range(3)]
    p = [px * m[4 * i] + py * m[4 * i + 1] + m[4 * i + 3] for i in range(3)]
    length, den = F.sqrt(_dot(d, d)), _dot(d, n)
    depth = F.try_divide(_dot([a - b for a, b in zip(o, p, strict=True)], n), den)
    q = [a + depth * b for a, b in zip(p, d, strict=True)]
    on = lambda axis: _dot([a - b for a, b in zip(q, o, strict=True)], axis)
    steep = (length >= 1e-12) & (F.abs(den) >= length * F.sqrt(_dot(n, n)) * R.MIN_RAY_COSINE)
    hit = F.struct(on(u).alias("x"), on(v).alias("y"), depth.alias("depth"), F.array(*q).alias("point"))
    return F.when(steep & N.finite(depth) & (depth > 0), hit)


def run_problem(runs: DataFrame, visible: DataFrame) -> DataFrame:
    """runs with `problem`: why nothing of a run can be mapped, or null.

    visible (view_id, wall_id): walls with at least one pixel in a view."""
    h, m = _at("h", 9), _at("camera", 16)
    size = F.sqrt(F.aggregate("h", F.lit(0.0), lambda a, x: a + x * x))
    minor = lambda i, j: h[3 * (i % 3) + j % 3] * h[3 * ((i + 1) % 3) + (j + 1) % 3] - h[3 * (i % 3) + (j + 1) % 3] * h[3 * ((i + 1) % 3) + j % 3]
    minors = F.sqrt(sum((minor(i, j) * minor(i, j) for i in range(3) for j in range(3)), F.lit(0.0)))  # det over this: the least singular value
    det = h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])
    finite = lambda c, n: (F.size(c) == n) & F.forall(c, lambda x: N.finite(x))
    affine = F.greatest(F.abs(m[12]), F.abs(m[13]), F.abs(m[14]), F.abs(m[15] - 1)) <= 1e-12
    seen = visible.select("view_id", "wall_id").distinct().withColumn("_seen", F.lit(True))
    out = runs.join(grown(seen), ["view_id", "wall_id"], "left")
    middle = wall_hit(F.col("render_w") / 2, F.col("render_h") / 2)
    ok = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(~ok(finite("h", 9) & (F.abs(det) > SINGULAR * size * minors)), "invalid_homography")
        .when(~ok(N.finite(F.col("photo_w"), F.col("photo_h")) & (F.least("photo_w", "photo_h") > 0)), "invalid_photo_size")
        .when(~ok(finite("camera", 16) & affine), "camera_not_orthographic")
        .when(~ok(finite("origin", 3) & finite("u", 3) & finite("v", 3)), "wall_not_supported_by_planar_reader")
        .when(F.col("_seen").isNull(), "wall_not_visible_in_view").when(middle.isNull(), "no_stable_rays_to_wall")
    )
    return out.withColumn("problem", problem).drop("_seen")


def _hits(px: np.ndarray, py: np.ndarray, m: np.ndarray, o: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """wall_hit for render pixels (rows, 4): which have a meeting, x, y, depth, and points (rows, 4, 3)."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    o, u, v = ([c[:, i, None] for i in range(3)] for c in (o, u, v))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    d = [m[:, 4 * i + 2, None] for i in range(3)]
    with np.errstate(all="ignore"):
        p = [px * m[:, 4 * i, None] + py * m[:, 4 * i + 1, None] + m[:, 4 * i + 3, None] for i in range(3)]
        length, den = np.sqrt(dot(d, d)), dot(d, n)
        depth = dot([a - b for a, b in zip(o, p, strict=True)], n) / den
        q = [a + depth * b for a, b in zip(p, d, strict=True)]
        rel = [a - b for a, b in zip(q, o, strict=True)]
        steep = (length >= 1e-12) & (np.abs(den) >= length * np.sqrt(dot(n, n)) * R.MIN_RAY_COSINE)
        return steep & np.isfinite(depth) & (depth > 0), dot(rel, u), dot(rel, v), depth, np.stack(q, axis=2)


def on_walls(det: DataFrame, runs: DataFrame, run: str, kept: list[str] | None = None) -> DataFrame:
    """det (run, class, box) joined with its run: hits of the four corners (see wall_hit), area_m2, and the first of the first
    eight reasons as reject_reason. A batch of rows is worked at once, in the order of operations of the columns' forms.

    kept: the columns to keep, all if None; then there are quad (x and y of the corners on the wall), width_m and height_m in
    place of hits, and rows with a `problem` have that as their reason."""
    joined = det.join(runs, run)
    if kept is not None:
        joined = joined.select(*dict.fromkeys([*kept, "problem", "class", "x0", "y0", "x1", "y1", "photo_w", "photo_h", "render_w", "render_h", "h", "camera", "origin", "u", "v"]))
    point = "array<struct<x: double, y: double, depth: double, point: array<double>>>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            x0, y0, x1, y1, pw, ph, rw, rh = (number(c) for c in ("x0", "y0", "x1", "y1", "photo_w", "photo_h", "render_w", "render_h"))
            h, m, o, u, v = (X.numbers(b.column(c), n) for c, n in (("h", 9), ("camera", 16), ("origin", 3), ("u", 3), ("v", 3)))
            with np.errstate(all="ignore"):
                size = np.zeros(len(h))
                for i in range(9):
                    size = size + h[:, i] * h[:, i]
                cx, cy = np.stack([x0, x1, x1, x0], axis=1), np.stack([y0, y0, y1, y1], axis=1)
                w = (cx * h[:, 6, None] + cy * h[:, 7, None] + h[:, 8, None]) / np.sqrt(size)[:, None]
                one_side = b.column("h").is_valid().to_numpy(zero_copy_only=False) & (~(w <= R.POLE)).all(axis=1) | (w < -R.POLE).all(axis=1)
                px, py = X.project(cx, cy, h)
                within = ((px >= -0.5) & (py >= -0.5) & (px < rw[:, None] - 0.5) & (py < rh[:, None] - 0.5)).all(axis=1)
                met, x, y, depth, q = _hits(px, py, m, o, u, v)
                met = met.all(axis=1)
                area = np.zeros(len(h))
                for i in range(4):
                    j = (i + 1) % 4
                    area = area + (x[:, i] * y[:, j] - x[:, j] * y[:, i])
                area = np.abs(area / 2)
                sound = np.isfinite(x0) & np.isfinite(y0) & np.isfinite(x1) & np.isfinite(y1) & (x1 > x0) & (y1 > y0)
                outside = (x0 < 0) | (y0 < 0) | (x1 > pw) | (y1 > ph)
                border = (x0 <= R.BORDER) | (y0 <= R.BORDER) | (x1 >= pw - R.BORDER) | (y1 >= ph - R.BORDER)
                known = pc.is_in(b.column("class"), pa.array(CLASSES)).to_numpy(zero_copy_only=False)
                tests = np.stack([~known, ~sound, outside, border, ~one_side, ~within, ~met, area < R.MIN_AREA], axis=1)
            first = np.where(tests.any(axis=1), tests.argmax(axis=1), -1)
            reason = pa.array(REASONS).take(pa.array(first, mask=first < 0))
            if kept is not None:
                reason = pc.coalesce(b.column("problem"), reason)
                free = reason.is_null()
                side = lambda i, j: np.sqrt((x[:, i] - x[:, j]) ** 2 + (y[:, i] - y[:, j]) ** 2)  # noqa: B023, E731
                quad = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * x.size + 1, 8, dtype=np.int32)), pa.array(np.stack([x, y], axis=2).ravel()), mask=reason.is_valid())
                none = reason.is_valid().to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    sizes = [pa.array(v, mask=none) for v in ((side(1, 0) + side(2, 3)) / 2, (side(3, 0) + side(2, 1)) / 2, area)]
                only = lambda c: pc.if_else(free, b.column(c), pa.scalar(None, b.column(c).type)) if c in OPEN else b.column(c)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(only(c) for c in kept), quad, *sizes, reason], [*kept, "quad", "width_m", "height_m", "area_m2", "reject_reason"])
                continue
            flat = pa.StructArray.from_arrays([x.ravel(), y.ravel(), depth.ravel(), pa.ListArray.from_arrays(np.arange(0, q.size + 1, 3, dtype=np.int32), q.ravel())], ["x", "y", "depth", "point"])
            hits = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 4, dtype=np.int32)), flat, mask=pa.array(~met))
            yield pa.RecordBatch.from_arrays([*b.columns, hits, pa.array(area, mask=~met), reason], [*b.schema.names, "hits", "area_m2", "reject_reason"])

    if kept is not None:
        fields = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in kept)
        return joined.mapInArrow(place, f"{fields}, quad array<double>, width_m double, height_m double, area_m2 double, reject_reason string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.mapInArrow(place, f"{fields}, hits {point}, area_m2 double, reject_reason string")


def ring_edges(rings: DataFrame) -> DataFrame:
    """rings (wall_id, ring_id, points: structs x, y) as edges (wall_id, ring_id, ax, ay, bx, by), with the ring's box and points."""
    n = F.size("points")
    box = {f"{f}_{c}": g(F.col(f"points.{c}")) for f, g in (("least", F.array_min), ("most", F.array_max)) for c in "xy"}
    e = rings.where(n >= 3).withColumns(box).select("wall_id", "ring_id", *box, F.posexplode("points").alias("i", "a"), F.col("points"))
    e = e.withColumn("b", F.get("points", F.pmod(F.col("i") + 1, F.size("points"))))
    return e.where("a <> b").select("wall_id", "ring_id", *box, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "points")


def inside_edges(quad: np.ndarray, edges: np.ndarray, tolerance: float) -> bool:
    """inside_all for one quadrangle (4, 2) and its edges (n, 4)."""
    return bool(inside_all(quad[None], edges[None], tolerance)[0])


def inside_all(quads: np.ndarray, edges: np.ndarray, tolerance: float) -> np.ndarray:
    """Which quadrangles (rows, 4, 2) lie in a ring of which `edges` (rows, n, 4) holds all that cross their height at or to the
    right of their left end: corners, centre, and the points halfway between places where their edges meet the ring."""
    a, b = edges[:, :, :2], edges[:, :, 2:]
    start, step = quads, np.roll(quads, -1, axis=1) - quads
    along, gap = b - a, a[:, None] - start[:, :, None]
    cross = lambda p, q: p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        den = cross(step[:, :, None], along[:, None])
        here, there = cross(gap, along[:, None]) / den, cross(gap, step[:, :, None]) / den
        on_both = (np.abs(den) > FLAT) & (np.abs(here - 0.5) <= 0.5 + ENDS) & (np.abs(there - 0.5) <= 0.5 + ENDS)
        runs_along = (np.abs(den) <= FLAT) & (np.abs(cross(step[:, :, None], gap)) < ENDS)
        square = (step * step).sum(axis=2)[:, :, None]
        feet = [np.where(runs_along, ((end[:, None] - start[:, :, None]) * step[:, :, None]).sum(axis=3) / square, 0.0) for end in (a, b)]
    edge = np.zeros((*quads.shape[:2], 1))
    t = np.concatenate([np.where(on_both, here, 0.0), *feet, edge, edge + 1], axis=2)
    t = np.sort(np.clip(np.nan_to_num(t), 0.0, 1.0), axis=2)
    between = start[:, :, None] + ((t[..., 1:] + t[..., :-1]) / 2)[..., None] * step[:, :, None]
    p = np.concatenate([quads, quads.mean(axis=1)[:, None], between.reshape(len(quads), -1, 2)], axis=1)
    rel, along = p[:, :, None] - a[:, None], along[:, None]
    place = np.clip((rel * along).sum(axis=3) / np.maximum((along * along).sum(axis=3), 1e-300), 0.0, 1.0)
    near = np.sqrt(((rel - place[..., None] * along) ** 2).sum(axis=3)).min(axis=2, initial=np.inf) <= max(tolerance, 1e-9)
    return (near | _odd(p, a, b)).all(axis=1)


def _odd(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which points (rows, m, 2) have an odd number of the row's edges to their right."""
    py, (ax, ay), (bx, by) = p[:, :, None, 1], (a[:, None, :, i] for i in (0, 1)), (b[:, None, :, i] for i in (0, 1))
    spans = (ay > py) != (by > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = ax + (py - ay) * (bx - ax) / (by - ay)
    return (spans & (x > p[:, :, None, 0])).sum(axis=2) % 2 == 1


def _kept(quads: np.ndarray, ends: np.ndarray, edges: np.ndarray, tolerance: float) -> np.ndarray:
    """inside_all for rows with edges[ends[i]:ends[i + 1]], those with equally many at once, in lots of bounded size."""
    n, out = np.diff(ends), np.zeros(len(quads), dtype=bool)
    for k in np.unique(n):
        rows = np.flatnonzero(n == k)
        lot = max(1, LOT // int((12 * k + 9) * max(k, 1)))
        for i in range(0, len(rows), lot):
            r = rows[i : i + lot]
            out[r] = inside_all(quads[r], edges[ends[r][:, None] + np.arange(k)], tolerance)
    return out


def _beside(quads: np.ndarray, ends: np.ndarray, edges: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """ends and edges as in _kept, of each row only the edges at its height and at or to the right of its left end."""
    row = np.repeat(np.arange(len(quads)), np.diff(ends))
    edges = edges[ends[0] : ends[-1]]
    (left, low), high = quads.min(axis=1).T - tolerance, quads[:, :, 1].max(axis=1) + tolerance
    x, y = edges[:, 0::2], edges[:, 1::2]
    take = (x.max(axis=1) >= left[row]) & (y.max(axis=1) >= low[row]) & (y.min(axis=1) <= high[row])
    return np.concatenate([[0], np.cumsum(np.bincount(row[take], minlength=len(quads)))]), edges[take]


def within_rings(quads: DataFrame, rings: DataFrame, key: list[str], tolerance: float = TOLERANCE, band: float = BAND, cell: float = CELL) -> DataFrame:
    """The keys of the quads (key, wall_id, hits or quad: x and y of four corners) that lie in one of their wall's rings as a
    whole, give or take tolerance."""
    at = lambda c, i: F.get("quad", F.lit(2 * i + "xy".index(c))) if "quad" in quads.columns else F.get("hits", F.lit(i))[c]
    q = quads.select(*key, "wall_id", *[at(c, i).alias(f"{c}{i}") for i in range(4) for c in "xy"])
    most = {f"q{f}_{c}": g(*[F.col(f"{c}{i}") for i in range(4)]) for f, g in (("least", F.least), ("most", F.greatest)) for c in "xy"}
    edges = ring_edges(rings)
    number = lambda v: F.floor(v / cell)
    # the ring's box is filed in the cells it covers, and a quadrangle looks in that of its lower left corner; a ring of few edges
    # comes with them and is met there and then
    boxes = edges.groupBy("wall_id", "ring_id", "least_x", "most_x", "least_y", "most_y").agg(F.flatten(F.collect_list(F.when(F.size("points") <= FEW, F.array("ax", "ay", "bx", "by")))).alias("edges"))
    over = lambda c: F.explode(F.sequence(number(F.col(f"least_{c}") - tolerance), number(F.col(f"most_{c}") + tolerance)))
    boxes = boxes.withColumn("lot_x", over("x")).withColumn("lot_y", over("y"))
    # a quadrangle within a ring is within its box: this also bounds the bands of a quadrangle by those of the ring
    fits = [F.col(f"qleast_{c}") >= F.col(f"least_{c}") - tolerance for c in "xy"] + [F.col(f"qmost_{c}") <= F.col(f"most_{c}") + tolerance for c in "xy"]
    q = q.withColumns({f"lot_{c}": number(most[f"qleast_{c}"]) for c in "xy"}).join(grown(boxes), ["wall_id", "lot_x", "lot_y"]).drop("lot_x", "lot_y")
    q = q.withColumns(most).where(fits[0] & fits[1] & fits[2] & fits[3]).drop("least_x", "most_x", "least_y", "most_y")
    corner = [f"{c}{i}" for i in range(4) for c in "xy"]
    few = q.where(F.size("edges") > 0).select(*key, *corner, "edges")
    q = q.where(F.size("edges") == 0).drop("edges")
    row = lambda v: F.floor(v / band)
    q = q.withColumns({"q_first": row(F.col("qleast_y") - tolerance), "q_last": row(F.col("qmost_y") + tolerance)}).withColumn("band", F.explode(F.sequence("q_first", "q_last")))
    e = edges.where(F.size("points") > FEW).select("wall_id", "ring_id", "ax", "ay", "bx", "by", row(F.least("ay", "by")).alias("e_first"), row(F.greatest("ay", "by")).alias("e_last"))
    e = e.withColumn("band", F.explode(F.sequence("e_first", "e_last")))
    met = q.join(grown(e), ["wall_id", "ring_id", "band"]).where((F.col("band") == F.greatest("q_first", "e_first")) & (F.greatest("ax", "bx") >= F.col("qleast_x") - tolerance))
    gathered = met.groupBy(*key, "ring_id", *corner).agg(F.flatten(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quad = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in corner], axis=1).reshape(-1, 4, 2)
            lists = batch.column("edges")
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).reshape(-1, 4)
            ends, flat = _beside(quad, ends // 4, flat, tolerance)
            yield batch.select(key).filter(pa.array(_kept(quad, ends, flat, tolerance)))

    schema = ", ".join(f"`{k}` {gathered.schema[k].dataType.simpleString()}" for k in key)
    return few.mapInArrow(run, schema).union(gathered.select(*key, *corner, "edges").mapInArrow(run, schema)).distinct()


def seen_shares(boxes: DataFrame, pixels: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """Shares of a grid of points over each box that lie on its wall (its openings count for it) and on other surfaces, and
    whether that supports it. boxes (key, box, h, view_id, building_id, wall_id), pixels (view_id, x, y, object_index)."""
    own = objects.where(F.col("kind").isin(*WALL_KINDS)).groupBy("building_id", "wall_id").agg(F.collect_set(F.col("object_index").cast("int")).alias("mine"))
    out = X.shares(boxes.join(grown(own), ["building_id", "wall_id"], "left"), pixels, key)
    return out.withColumn("supported", F.col("middle") & (F.col("same_wall") >= R.MIN_SAME) & (F.col("other_surface") <= R.MAX_OTHER)).drop("middle")


def map_runs(det: DataFrame, runs: DataFrame, rings: DataFrame, pixels: DataFrame, objects: DataFrame, run: str = "run", order: str = "ord", places: bool = True) -> DataFrame:
    """det (run, ord, class, box) of all runs with prediction_id, reject_reason (null: mapped), sizes and place.

    runs (run, photo_w, photo_h, render_w, render_h, h, camera, origin, u, v, view_id, building_id, wall_id); rings
    (wall_id, ring_id, points) outer boundaries on the wall; pixels (view_id, x, y, object_index) visible surfaces;
    objects (building_id, object_index, kind, wall_id). Detections of runs with a problem (see run_problem) get it as
    reject_reason. Only mapped ones have sizes and hits. Runs and detections are named by (run, ord). places: whether hits
    are asked for; they are most of a detection's bytes."""
    key = [run, order]
    allowed = objects.where(F.col("kind").isin(*WALL_KINDS) & F.col("wall_id").isNotNull()).select("building_id", "object_index", "wall_id")
    views = runs.select("view_id", "building_id").distinct()
    visible = pixels.select("view_id", "object_index").distinct().join(views, "view_id").join(grown(allowed), ["building_id", "object_index"])
    kept = [*key, "class", "wall_id", *OPEN]
    runs = run_problem(runs, visible)
    if places:
        placed = on_walls(det, runs, run).withColumn("reject_reason", F.coalesce("problem", "reject_reason"))
        hit = lambda i, c: F.get("hits", F.lit(i))[c]
        side = lambda i, j: F.sqrt(F.pow(hit(i, "x") - hit(j, "x"), 2) + F.pow(hit(i, "y") - hit(j, "y"), 2))
        placed = placed.withColumns({"quad": F.array(*[hit(i, c) for i in range(4) for c in "xy"]), "width_m": (side(1, 0) + side(2, 3)) / 2, "height_m": (side(3, 0) + side(2, 1)) / 2})
        found = ["width_m", "height_m", "area_m2", "hits"]
        free = lambda c: F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c)
        placed = placed.select(*key, "class", "wall_id", "reject_reason", *[free(c) for c in (*OPEN, "quad", *found)])
    else:
        placed = on_walls(det, runs, run, kept)
        found = ["width_m", "height_m", "area_m2"]
    first = stored(placed, "mapping")
    open_ = first.where("reject_reason IS NULL")
    inside = stored(within_rings(open_, rings, key), "mapping")
    boxes = stored(open_.select(*key, "wall_id", *OPEN).join(inside, key, "left_semi"), "mapping")
    # who lies in a ring has shares, so these also tell who does
    shares = stored(seen_shares(boxes, pixels, objects, key), "mapping")
    late = F.when(F.col("same_wall").isNull(), REASONS[8]).when(~F.coalesce("supported", F.lit(False)), REASONS[9])
    held = [*key, "class", "wall_id", "reject_reason", *found, "same_wall", "other_surface"]
    judged = open_.select(*key, "class", "wall_id", *found).join(shares, key, "left").withColumn("reject_reason", late).select(*held)
    out = first.where("reject_reason IS NOT NULL").select(*held[:-2], *[F.lit(None).cast("double").alias(c) for c in held[-2:]]).union(judged)
    return out.select(
        *key, "class", "wall_id", F.format_string("P%04d", F.col(order)).alias("prediction_id"), "reject_reason", "same_wall", "other_surface",
        *[F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c) for c in ("hits", "width_m", "height_m", "area_m2") if c in found],
    )


def map_status(mapped: DataFrame, run: str = "run") -> DataFrame:
    """Of each run how many detections were mapped and rejected, and its status."""
    ok = F.col("reject_reason").isNull()
    out = mapped.groupBy(run).agg(F.count_if(ok).alias("mapped"), F.count_if(~ok).alias("rejected"))
    return out.withColumn("status", F.when(F.col("mapped") > 0, "preview_created").otherwise("no_detections_mapped"))
