"""Visible surfaces by depth buffers of screen tiles.

A triangle goes to the screen tiles that its box touches. A task keeps a depth buffer for each tile it meets, works its
triangles into it, and sends buffers, not pixels; buffers of one tile are merged by taking the nearer surface, in any order.
So no row stands for a pixel that is covered and hidden, a tile that most triangles touch is divided over the tasks that hold
them, and memory is bounded by the buffers a task keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import dealt

from .raster import Z_TIE

TILE = 64
BUFFERS = 256
"""Depth buffers that a task keeps before it sends them."""
DEALS = 8
"""Shares into which the triangles of a tile are dealt."""
LOT = 1 << 18
"""Pixels that triangles are tested for at once."""
THIN = 1e-12
"""Twice the area below which a triangle covers nothing."""
CORNERS = ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")


class Buffer:
    """Nearest depth, its triangle and its object for each pixel of a tile; triangle -1: none."""

    def __init__(self, data: bytes | None = None):
        n = TILE * TILE
        if data is None:
            self.depth, self.tri, self.object = np.full(n, np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int32)
        else:
            self.depth, self.tri, self.object = (np.frombuffer(data, t, n, at).copy() for t, at in ((np.float64, 0), (np.int64, 8 * n), (np.int32, 16 * n)))

    def bytes(self) -> bytes:
        return self.depth.tobytes() + self.tri.tobytes() + self.object.tobytes()

    def put(self, at, depth, tri, object_) -> None:
        """Takes surfaces that are nearer, or as near and of an earlier triangle; each pixel at most once."""
        better = (depth < self.depth[at]) | ((depth == self.depth[at]) & (tri < self.tri[at]))
        at = at[better]
        self.depth[at] = depth[better]
        self.tri[at] = tri[better] if np.ndim(tri) else tri
        self.object[at] = object_[better] if np.ndim(object_) else object_

    def merge(self, other: Buffer) -> None:
        at = np.flatnonzero(other.tri >= 0)
        self.put(at, other.depth[at], other.tri[at], other.object[at])

    def draw(self, corners: np.ndarray, tri: np.ndarray, object_: np.ndarray, x0: int, y0: int, width: int, height: int, digits: int | None) -> None:
        """Works triangles (rows, 9) into the tile whose first pixel is (x0, y0), of a screen of width x height."""
        area = (corners[:, 3] - corners[:, 0]) * (corners[:, 7] - corners[:, 1]) - (corners[:, 6] - corners[:, 0]) * (corners[:, 4] - corners[:, 1])
        first, last = np.array([x0, y0]), np.array([min(x0 + TILE, width), min(y0 + TILE, height)]) - 1
        flat = corners.reshape(-1, 3, 3)[:, :, :2]
        lo = np.ceil(np.clip(flat.min(axis=1), first, last + 1)).astype(np.int64)
        hi = np.floor(np.clip(flat.max(axis=1), first - 1, last)).astype(np.int64)
        side = np.maximum(hi - lo + 1, 0)
        n = np.where(np.abs(area) > THIN, side[:, 0] * side[:, 1], 0)
        rows = np.flatnonzero(n)
        lots = np.cumsum(n[rows]) // LOT
        for lot in np.split(rows, np.flatnonzero(np.diff(lots)) + 1) if len(rows) else ():
            k, size = np.repeat(lot, n[lot]), n[lot]
            at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            down = at // side[k, 0]
            i, j = down + lo[k, 1], at - down * side[k, 0] + lo[k, 0]
            ax, ay, az, bx, by, bz, cx, cy, cz = corners[k].T
            x, y, whole = j.astype(float), i.astype(float), area[k]
            edge = lambda px, py, qx, qy: ((qx - px) * (y - py) - (qy - py) * (x - px)) / whole  # noqa: B023, E731
            wa, wb, wc = edge(bx, by, cx, cy), edge(cx, cy, ax, ay), edge(ax, ay, bx, by)
            depth = wa * az + wb * bz + wc * cz
            if digits is not None:
                depth = np.round(depth, digits)
            on = (wa >= -Z_TIE) & (wb >= -Z_TIE) & (wc >= -Z_TIE) & (depth > 0) & np.isfinite(depth)
            at, depth, k = ((i - y0) * TILE + j - x0)[on], depth[on], k[on]
            near = depth <= self.depth[at]
            at, depth, k = at[near], depth[near], k[near]
            order = np.lexsort((tri[k], depth, at))
            order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])] if len(order) else order
            self.put(at[order], depth[order], tri[k[order]], object_[k[order]])


def buffers(triangles: DataFrame, width: int, height: int, digits: int | None = None) -> DataFrame:
    """(view_id, tx, ty, data): the depth buffer of each screen tile that holds a surface.

    triangles (view_id, tri_id, object_index, ax, ay, az .. cz in pixels, depth positive); rows that are not finite cover
    nothing. Depths are compared after rounding to `digits`, if given; of equal ones the lesser tri_id is in front."""
    kind = triangles.schema["view_id"].dataType.simpleString()
    low = lambda c, n: F.greatest(F.lit(0.0), F.least(f"a{c}", f"b{c}", f"c{c}"))
    high = lambda c, n: F.least(F.lit(n - 1.0), F.greatest(f"a{c}", f"b{c}", f"c{c}"))
    span = lambda c, n: F.explode(F.sequence(F.floor(low(c, n) / TILE).cast("int"), F.floor(high(c, n) / TILE).cast("int"))).alias(f"t{c}")
    finite = F.forall(F.array(*CORNERS), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    t = triangles.where(finite).where((low("x", width) <= high("x", width)) & (low("y", height) <= high("y", height)))
    t = t.select("view_id", "tri_id", "object_index", *CORNERS, span("x", width)).select("*", span("y", height))
    t = t.select("view_id", F.col("tx").cast("int"), F.col("ty").cast("int"), F.col("tri_id").cast("long"), F.col("object_index").cast("int"), *[F.col(c).cast("double") for c in CORNERS])
    # few and small files would be few tasks: tiles are dealt, each to a few tasks
    t = dealt(t, "view_id", "tx", "ty", F.pmod("tri_id", F.lit(DEALS)))
    view = pa.schema([pa.field("view_id", {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]), ("tx", pa.int32()), ("ty", pa.int32()), ("data", pa.binary())])

    def told(held: dict[tuple, Buffer]) -> pa.RecordBatch:
        rows = [(*k, b.bytes()) for k, b in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 4, view, strict=True)], schema=view)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Buffer] = {}
        for b in batches:
            codes = np.stack([b.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), *(b.column(c).to_numpy() for c in ("tx", "ty"))], axis=1)
            tri, kinds = b.column("tri_id").to_numpy(), pc.fill_null(b.column("object_index"), -1).to_numpy()
            corners = np.stack([b.column(c).to_numpy() for c in CORNERS], axis=1)
            _, which = np.unique(codes, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(which.ravel()[order])) + 1) if len(order) else ():
                v, tx, ty = key = tuple(b.column(c)[int(rows[0])].as_py() for c in range(3))
                if key not in held:
                    if len(held) >= BUFFERS:
                        yield told(held)
                        held.clear()
                    held[key] = Buffer()
                held[key].draw(corners[rows], tri[rows], kinds[rows], tx * TILE, ty * TILE, width, height, digits)
        yield told(held)

    def merge(table: pa.Table) -> pa.Table:
        out = Buffer()
        for data in table["data"]:
            out.merge(Buffer(data.as_py()))
        return pa.table([*(table[c].slice(0, 1) for c in ("view_id", "tx", "ty")), pa.array([out.bytes()], pa.binary())], schema=table.schema)

    schema = f"view_id {kind}, tx int, ty int, data binary"
    return t.mapInArrow(draw, schema).groupBy("view_id", "tx", "ty").applyInArrow(merge, schema)


def pixels(tiles: DataFrame) -> DataFrame:
    """(view_id, x, y, object_index, depth) of each pixel that shows a surface."""
    kind = tiles.schema["view_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (tx, ty, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("tx", "ty", "data")), strict=True)):
                buffer = Buffer(data)
                at = np.flatnonzero(buffer.tri >= 0)
                v = b.column("view_id").take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([v, pa.array((at % TILE + tx * TILE).astype(np.int32)), pa.array((at // TILE + ty * TILE).astype(np.int32)), pa.array(buffer.object[at]), pa.array(buffer.depth[at])], ["view_id", "x", "y", "object_index", "depth"])

    return tiles.mapInArrow(run, f"view_id {kind}, x int, y int, object_index int, depth double")


def visible(triangles: DataFrame, width: int, height: int, digits: int | None = None) -> DataFrame:
    """The visible surface of each pixel of each view (see buffers)."""
    return pixels(buffers(triangles, width, height, digits))
