"""Planes of walls from sums over their corners.

A plane's normal is the direction in which its points scatter least: the first eigenvector of the 3 x 3 matrix of their second
moments. Moments are sums, so Spark combines them map-side and a key's points never meet in one task; of each key only its
matrix reaches the eigenvector kernel. A wall's u is level and its v points up, which swaps of the normal's components give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.03
"""Metres that a corner may be off the plane."""
THIN = 1e-14
"""Share of the largest moment below which the second one makes a line."""
STEEP = 0.1
"""Length of the normal's level part from which on a plane is a wall."""


def axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of moment matrices (k, 3, 3): normals, u, v (nan where the plane is level), and which are lines, and level."""
    size, ways = np.linalg.eigh(scatter)
    n = ways[:, :, 0]
    level = np.hypot(n[:, 0], n[:, 1])
    flat = level < STEEP
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.where(flat[:, None], np.nan, np.stack([-n[:, 1], n[:, 0], np.zeros(len(n))], axis=1) / level[:, None])
        v = np.where(flat[:, None], np.nan, np.stack([-n[:, 2] * n[:, 0], -n[:, 2] * n[:, 1], level**2], axis=1) / level[:, None])
    most = np.take_along_axis(u, np.abs(np.nan_to_num(u)).argmax(axis=1)[:, None], axis=1)
    u = np.where(most < 0, -u, u) + 0.0
    return n, u, v + 0.0, size[:, 1] <= THIN * np.maximum(size[:, 2], 1e-300), flat


def _problem(line: bool, flat: bool, deviation: float) -> str | None:
    return "points are collinear" if line else "points are not planar" if deviation > TOLERANCE else "plane is level" if flat else None


def plane_frame(points: np.ndarray) -> dict:
    """origin, u, v and the largest deviation of one wall's points; ValueError if they are no planar wall."""
    centre = points.mean(axis=0)
    rel = points - centre
    n, u, v, line, flat = (x[0] for x in axes((rel.T @ rel)[None]))
    deviation = float(np.abs(rel @ n).max())
    if problem := _problem(bool(line) or len(points) < 3, bool(flat), deviation):
        raise ValueError(problem)
    return {"origin": centre.tolist(), "u": u.tolist(), "v": v.tolist(), "deviation": deviation}


def frames(points: DataFrame, key: str) -> DataFrame:
    """(key, origin, u, v, deviation, error): plane_frame of each key's points (key, x, y, z)."""
    centre = points.groupBy(key).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_{c}") for c in "xyz"])
    rel = points.join(centre, key).select(key, "_n", "_x", "_y", "_z", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"])
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = rel.groupBy(key, "_n", "_x", "_y", "_z").agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])
    place = {p: (i, j) for p in ("".join(x) for x in pairs) for i, j in [("xyz".index(p[0]), "xyz".index(p[1]))]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.zeros((b.num_rows, 3, 3))
            for p, (i, j) in place.items():
                m[:, i, j] = m[:, j, i] = b.column(p).to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(m).all(axis=(1, 2))
            n, u, v, line, flat = axes(np.where(bad[:, None, None], np.eye(3), m))
            o = np.stack([b.column(f"_{c}").to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (o, n, u, v)]
            yield pa.RecordBatch.from_arrays([b.column(key), *lists, pa.array(line | bad | (b.column("_n").to_numpy() < 3)), pa.array(flat)], [key, "origin", "n", "u", "v", "line", "flat"])

    kind = points.schema[key].dataType.simpleString()
    planes = moments.mapInArrow(run, f"`{key}` {kind}, origin array<double>, n array<double>, u array<double>, v array<double>, line boolean, flat boolean")
    off = sum(((F.col(c) - F.get("origin", F.lit(i))) * F.get("n", F.lit(i)) for i, c in enumerate("xyz")), F.lit(0.0))
    far = points.join(planes.select(key, "origin", "n"), key).groupBy(key).agg(F.max(F.abs(off)).alias("deviation"))
    error = F.when(F.col("line"), "points are collinear").when(F.col("deviation") > TOLERANCE, "points are not planar").when(F.col("flat"), "plane is level")
    out = planes.join(far, key).withColumn("error", error)
    held = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return out.select(key, *[held(c) for c in ("origin", "u", "v", "deviation")], "error")
