"""Numeric kernels for grouped maps: homographies, hulls, polygons. Each works on one bounded group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import numeric as N
from quoin.runtime import dealt

RANSAC_PX, RANSAC_ROUNDS, TRAIN_MIN = 4.0, 10_000, 4
RANSAC_LEAST, RANSAC_CONFIDENCE = 500, 0.999
AREA_RTOL = 1e-5
PART = 1 << 20
"""Points of a task that are put into its hulls at once."""
BLOCK = 1 << 14
"""Points whose errors are worked at once."""
PAIRS_AT_ONCE, PAIRS_TRIED = 1 << 21, 100_000


def normaliser(p: np.ndarray) -> np.ndarray:
    """Similarity that moves points to mean zero and mean distance sqrt 2."""
    c = p.mean(axis=0)
    d = np.sqrt(((p - c) ** 2).sum(axis=1)).mean()
    if d < 1e-12:
        raise ValueError("points coincide")
    s = np.sqrt(2) / d
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def transform(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    with np.errstate(all="ignore"):
        out = q[:, :2] / q[:, 2:]
    out[np.abs(q[:, 2]) <= 1e-12] = np.nan
    return out


def errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of transformed points to where they should be; infinite where there is none."""
    with np.errstate(all="ignore"):
        x, y = a[:, 0], a[:, 1]
        w = x * h[2, 0] + y * h[2, 1] + h[2, 2]
        dx = (x * h[0, 0] + y * h[0, 1] + h[0, 2]) / w - b[:, 0]
        dy = (x * h[1, 0] + y * h[1, 1] + h[1, 2]) / w - b[:, 1]
        e = np.sqrt(dx * dx + dy * dy)
    e[(np.abs(w) <= 1e-12) | np.isnan(e)] = np.inf
    return e


def truncated(h: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float, most: float) -> float:
    """Sum of errors, none above limit, in blocks; infinite once it has reached `most`."""
    total = 0.0
    for i in range(0, len(a), BLOCK):
        total += float(np.minimum(errors(h, a[i : i + BLOCK], b[i : i + BLOCK]), limit).sum())
        if total >= most:
            return np.inf
    return total


def blocks(n: int) -> Iterator[slice]:
    return (slice(i, i + BLOCK) for i in range(0, n, BLOCK))


def fit_inliers(a: np.ndarray, b: np.ndarray, inliers: np.ndarray) -> np.ndarray:
    """fit_homography of the pairs that are inliers. Of many, blocks are worked one by one: of their equations only the
    triangular factor is kept, which has the same singular values and vectors."""
    n = int(inliers.sum())
    if n <= BLOCK:
        return fit_homography(a[inliers], b[inliers])
    parts = lambda p: (p[s][inliers[s]] for s in blocks(len(p)))
    moves = []
    for p in (a, b):
        c = sum(x.sum(axis=0) for x in parts(p)) / n
        if not np.isfinite(c).all():
            raise ValueError("at least four finite pairs are needed")
        d = sum(np.sqrt(((x - c) ** 2).sum(axis=1)).sum() for x in parts(p)) / n
        if d < 1e-12:
            raise ValueError("points coincide")
        s = np.sqrt(2) / d
        moves.append(np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]]))
    r, rx, ry = np.zeros((0, 9)), np.zeros((0, 2)), np.zeros((0, 2))
    for p, q in zip(parts(a), parts(b), strict=True):
        x, y = transform(moves[0], p), transform(moves[1], q)
        rx, ry = (np.linalg.qr(np.vstack(v), mode="r") for v in ((rx, x), (ry, y)))
        r = np.linalg.qr(np.vstack([r, equations(x, y)]), mode="r")
    if min(np.linalg.matrix_rank(v, tol=1e-6) for v in (rx, ry)) < 2:
        raise ValueError("points are collinear")
    return _solved(r, *moves, sum(x.sum(axis=0) for x in parts(a)) / n)


def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two rows of the direct linear transform for each pair of normalised points."""
    zero = np.zeros((len(x), 3))
    hom = np.column_stack([x, np.ones(len(x))])
    return np.vstack([np.hstack([hom, zero, -y[:, :1] * hom]), np.hstack([zero, hom, -y[:, 1:] * hom])])


def _solved(rows: np.ndarray, ta: np.ndarray, tb: np.ndarray, middle: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(rows, full_matrices=len(rows) < 9)
    if len(s) < 8 or s[7] < 1e-10 * s[0]:
        raise ValueError("pairs do not fix a homography")
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    h = h / np.linalg.norm(h)
    if abs(np.linalg.det(h)) < 1e-14:
        raise ValueError("homography is singular")
    return h if h[2] @ np.append(middle, 1) >= 0 else -h


def fit_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised direct linear transform from at least four pairs in general position; Frobenius norm one."""
    if len(a) < 4 or not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("at least four finite pairs are needed")
    ta, tb = normaliser(a), normaliser(b)
    x, y = transform(ta, a), transform(tb, b)
    if min(np.linalg.matrix_rank(p - p.mean(axis=0), tol=1e-6) for p in (x, y)) < 2:
        raise ValueError("points are collinear")
    return _solved(equations(x, y), ta, tb, a.mean(axis=0))


def distances(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of transformed points to where they should be, in blocks; huge where there is none."""
    out = np.empty(len(a))
    for s in blocks(len(a)):
        out[s] = np.nan_to_num(np.linalg.norm(transform(h, a[s]) - b[s], axis=1), nan=np.inf)
    return out


def ransac(a: np.ndarray, b: np.ndarray, limit: float = RANSAC_PX, rounds: int = RANSAC_ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Robust homography: the sample with the least truncated error, fitted again to its inliers until they settle.

    At most `rounds` samples; after RANSAC_LEAST, none once a clean one was drawn with RANSAC_CONFIDENCE, by the inlier
    share of the best so far."""
    rng = np.random.default_rng(seed)
    best, cost, enough = None, np.inf, float(rounds)
    for n in range(rounds):
        if n >= max(RANSAC_LEAST, enough):
            break
        pick = rng.choice(len(a), 4, replace=False)
        try:
            h = fit_homography(a[pick], b[pick])
        except (ValueError, np.linalg.LinAlgError):
            continue
        c = truncated(h, a, b, limit, cost)
        if c < cost:
            best, cost = h, c
            clean = (sum(int((errors(h, a[s], b[s]) <= limit).sum()) for s in blocks(len(a))) / len(a)) ** 4
            enough = np.log(1 - RANSAC_CONFIDENCE) / np.log1p(-clean) if 0 < clean < 1 else (rounds if clean == 0 else 0)
    if best is None:
        raise ValueError("no sample fixes a homography")
    inliers = np.zeros(len(a), dtype=bool)
    for _ in range(10):
        if (now := distances(best, a, b) <= limit).sum() < 4 or (now == inliers).all():
            break
        inliers = now
        best = fit_inliers(a, b, inliers)
    return best, inliers


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, counter-clockwise."""
    p = p[np.isfinite(p).all(axis=1)]
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    if len(p):  # on one x only the least and the greatest y can be corners
        turn = p[1:, 0] != p[:-1, 0]
        p = p[np.append(True, turn) | np.append(turn, True)]
        p = p[np.append(True, (p[1:] != p[:-1]).any(axis=1))]
    if len(p) < 3:
        return p
    out: list[tuple[float, float]] = []
    for points in (p.tolist(), p[::-1].tolist()):
        base = len(out)
        for x, y in points:
            while len(out) >= base + 2:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (y - by) - (by - ay) * (x - bx) > 0:
                    break
                out.pop()
            out.append((x, y))
        out.pop()
    return np.array(out)


def area(p: np.ndarray) -> float:
    """Signed area of a ring."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]  # near zero, as coordinates may be in the millions
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def coverage(p: np.ndarray, width: float, height: float) -> dict[str, float]:
    if len(p) < 3:
        return {"hull": 0.0, "x_span": 0.0, "y_span": 0.0}
    return {"hull": abs(area(hull(p))) / (width * height), "x_span": float(np.ptp(p[:, 0])) / width, "y_span": float(np.ptp(p[:, 1])) / height}


def coverage_groups(points: DataFrame, key: str, columns: list[str], width: float, height: float) -> DataFrame:
    """coverage() of each key's points, from the hulls of parts: a task keeps hulls, and a key's are put together."""
    kind = points.schema[key].dataType.simpleString()
    sums = ["n", "x0", "x1", "y0", "y1"]

    def state(parts: pd.DataFrame) -> pd.DataFrame:
        """One row for each key; hulls of points and of hulls are the same."""
        rows = []
        for k, g in parts.groupby(key, sort=False, dropna=False):
            p = hull(np.concatenate([np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1) for x, y in zip(g["xs"], g["ys"], strict=True)]))
            p = p.reshape(-1, 2)
            rows.append((k, int(g["n"].sum()), *(float(f(g[c].to_numpy(float))) for c, f in (("x0", np.min), ("x1", np.max), ("y0", np.min), ("y1", np.max))), p[:, 0], p[:, 1]))
        return pd.DataFrame(rows, columns=[key, *sums, "xs", "ys"])

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        """As state, of points."""
        rows = []
        for k, g in pdf.groupby(key, sort=False, dropna=False):
            x, y = (g[c].to_numpy(float) for c in columns)
            p = hull(np.stack([x, y], axis=1)).reshape(-1, 2)
            rows.append((k, len(g), x.min(), x.max(), y.min(), y.max(), p[:, 0], p[:, 1]))
        return pd.DataFrame(rows, columns=[key, *sums, "xs", "ys"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, n = [], [], 0
        for b in batches:
            waiting.append(b)
            n += len(b)
            if n >= PART:
                held = [state(pd.concat([*held, part(pd.concat(waiting))]))]
                waiting, n = [], 0
        if waiting:
            held.append(part(pd.concat(waiting)))
        if held:
            yield state(pd.concat(held))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        r = state(pdf).iloc[0]
        p = np.stack([r["xs"], r["ys"]], axis=1)
        few = r["n"] < 3
        return pd.DataFrame([{key: r[key], "hull": 0.0 if few else abs(area(p)) / (width * height), "x_span": 0.0 if few else (r["x1"] - r["x0"]) / width, "y_span": 0.0 if few else (r["y1"] - r["y0"]) / height, "error": None}])

    held = points.select(key, *[F.col(c).cast("double") for c in columns]).mapInPandas(parts, f"{key} {kind}, n long, x0 double, x1 double, y0 double, y1 double, xs array<double>, ys array<double>")
    return held.groupBy(key).applyInPandas(whole, f"{key} {kind}, hull double, x_span double, y_span double, error string")


def fit_groups(matches: DataFrame, key: str, photo: tuple[int, int], limit: float = RANSAC_PX, render: tuple[int, int] | None = None) -> DataFrame:
    """For each key a homography from its training rows and how it does on the held-out ones, which never enter the fit.

    matches (key, px, py, rx, ry, holdout); rows whose holdout is null, or whose point is outside the render image (if its
    size is given), take no part."""
    matches = matches.where("holdout IS NOT NULL")
    if render:
        matches = matches.where(N.inside(F.col("rx"), F.col("ry"), F.lit(render[0]), F.lit(render[1])))

    def fitted(k: object, train: np.ndarray, held: np.ndarray) -> dict:
        """train, held: px, py, rx, ry in their order."""
        base = {key: k, "n_train": len(train), "n_holdout": len(held)}
        none = {"h": None, "train_inliers": 0, "holdout_inlier_fraction": 0.0, "median_px": None, "hull": 0.0, "x_span": 0.0, "y_span": 0.0}
        if base["n_train"] < TRAIN_MIN:
            return base | none | {"error": "fewer than 4 training points after spatial hold-out"}
        a, b = train[:, :2], train[:, 2:]
        try:
            h, inliers = ransac(a, b, limit)
        except ValueError as e:
            return base | none | {"error": str(e)}
        e = distances(h, held[:, :2], held[:, 2:])
        parts = [a[s][inliers[s]] for s in blocks(len(a))]
        c = coverage(np.concatenate([hull(p) for p in parts]) if len(parts) > 1 else parts[0], *photo)
        row = {"h": h.ravel().tolist(), "train_inliers": int(inliers.sum()), "holdout_inlier_fraction": float((e <= limit).sum() / max(1, len(e))), "median_px": float(np.median(e)) if len(e) and np.isfinite(np.median(e)) else None}
        return base | row | c | {"error": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A key's rows follow each other in order; 32 bytes of each are held, with no copies of the whole."""
        here, kind, rows = None, None, None

        def end() -> pa.RecordBatch:
            train, held = (np.frombuffer(r, float).reshape(-1, 4) for r in rows)
            r = fitted(here[0], train, held)
            types = [kind, pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), *[pa.float64()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[n]], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(key).type
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in spot], axis=1).astype(float)
            out = batch.column("holdout").to_numpy(zero_copy_only=False).astype(bool)
            for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
                k = (batch.column(key)[int(s)].as_py(),)
                if k != here:
                    if here is not None:
                        yield end()
                    here, rows = k, (bytearray(), bytearray())
                for r, mine in zip(rows, (~out[s:e], out[s:e]), strict=True):
                    r.extend(np.ascontiguousarray(p[s:e][mine]).tobytes())
        if here is not None:
            yield end()

    spot = ["px", "py", "rx", "ry"]
    schema = f"{key} {matches.schema[key].dataType.simpleString()}, n_train long, n_holdout long, h array<double>, train_inliers long, holdout_inlier_fraction double, median_px double, hull double, x_span double, y_span double, error string"
    names = [key, "n_train", "n_holdout", "h", "train_inliers", "holdout_inlier_fraction", "median_px", "hull", "x_span", "y_span", "error"]
    rows = matches.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in spot], F.col("holdout").cast("boolean").alias("holdout"))
    return dealt(rows, key).sortWithinPartitions(key, *spot).mapInArrow(run, schema)


def _edges(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and directions of a ring's edges."""
    ring = np.asarray(ring, float)
    return ring, np.roll(ring, -1, axis=0) - ring


def ring_distance(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distance of each point to the ring's boundary: all points against all edges at once."""
    a, d = _edges(ring)
    rel = p[:, None] - a[None]
    along = np.clip((rel * d).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-300), 0.0, 1.0)
    return np.linalg.norm(rel - along[..., None] * d, axis=2).min(axis=1)


def inside(p: np.ndarray, ring: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """Which points are in a ring, by its winding number around them; what lies within tolerance of its boundary counts."""
    p = np.atleast_2d(np.asarray(p, float))
    a, _ = _edges(ring)
    to, nxt = a[None] - p[:, None], np.roll(a, -1, axis=0)[None] - p[:, None]
    turn = np.arctan2(to[..., 0] * nxt[..., 1] - to[..., 1] * nxt[..., 0], (to * nxt).sum(axis=2))
    return (np.abs(turn.sum(axis=1)) > np.pi) | (ring_distance(p, ring) <= max(tolerance, 1e-9))


def meetings(polygon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """For each edge of the polygon (a row) the places, 0 to 1 along it, where lines of the ring's edges or its corners
    may change sides; in order, padded with 0 and 1."""
    a, d = _edges(polygon)
    b, e = _edges(ring)
    gap = b[None] - a[:, None]
    den = d[:, None, 0] * e[None, :, 1] - d[:, None, 1] * e[None, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (gap[..., 0] * e[None, :, 1] - gap[..., 1] * e[None, :, 0]) / den
        foot = (gap * d[:, None]).sum(axis=2) / (d * d).sum(axis=1)[:, None]  # corners, for edges that run along
    t = np.concatenate([cross, foot, np.zeros((len(a), 1)), np.ones((len(a), 1))], axis=1)
    return np.sort(np.clip(np.nan_to_num(t, nan=0.0, posinf=1.0, neginf=0.0), 0.0, 1.0), axis=1)


def inside_ring(polygon: np.ndarray, ring: np.ndarray, tolerance: float = 0.0) -> bool:
    """Whether a polygon lies in a ring as a whole: its corners, its centre, and a point between each two neighbouring
    places at which an edge may enter or leave the ring."""
    polygon = np.asarray(polygon, float)
    t = meetings(polygon, ring)
    a, d = _edges(polygon)
    between = a[:, None] + ((t[:, 1:] + t[:, :-1]) / 2)[..., None] * d[:, None]
    return bool(inside(np.concatenate([polygon, polygon.mean(axis=0)[None], between.reshape(-1, 2)]), ring, tolerance).all())


def clean_ring(p: np.ndarray) -> np.ndarray:
    """Without points that repeat the one before them around the ring, so also without a closing point."""
    new = np.linalg.norm(p - np.roll(p, 1, axis=0), axis=1) > 1e-9
    return p[new] if new.any() else p[:1]


def bridged(outer: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """One ring from an outer ring and holes, joined by bridges to visible corners."""
    ring = outer if area(outer) > 0 else outer[::-1]
    for hole in sorted(holes, key=lambda h: -h[:, 0].max()):
        hole = hole if area(hole) < 0 else hole[::-1]
        k = int(hole[:, 0].argmax())
        p = hole[k]
        edges = [(hole[i], hole[(i + 1) % len(hole)]) for i in range(len(hole))] + [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]
        for i in np.argsort(((ring - p) ** 2).sum(axis=1), kind="stable"):
            if not any(_proper_cross(p, ring[i], a, b) for a, b in edges):
                ring = np.vstack([ring[: i + 1], np.roll(hole, -k, axis=0), hole[k : k + 1], ring[i : i + 1], ring[i + 1 :]])
                break
        else:
            raise ValueError("a hole cannot be reached")
    return ring


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _proper_cross(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    return _turn(a, b, c) * _turn(a, b, d) < -1e-18 and _turn(c, d, a) * _turn(c, d, b) < -1e-18


def triangulate(outer: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """Triangles (n, 3, 2) of a polygon by ear clipping; their area must be the polygon's."""
    ring = bridged(clean_ring(outer), [clean_ring(h) for h in holes])
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        for n in range(len(left)):
            i, j, k = left[n - 1], left[n], left[(n + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[k]
            if _turn(a, b, c) <= 1e-15:
                continue
            others = np.array([ring[m] for m in left if m not in (i, j, k) and not any((ring[m] == v).all() for v in (a, b, c))])
            if len(others):
                s = [np.array([_turn(p, q, o) for o in others]) for p, q in ((a, b), (b, c), (c, a))]
                if ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)).any():
                    continue
            out.append((a, b, c))
            del left[n]
            break
        else:
            flat = [n for n in range(len(left)) if abs(_turn(ring[left[n - 1]], ring[left[n]], ring[left[(n + 1) % len(left)]])) <= 1e-15]
            if not flat:
                raise ValueError("polygon has no ear")
            del left[flat[0]]
    out.append(tuple(ring[m] for m in left))
    t = np.array(out)
    want = abs(area(outer)) - sum(abs(area(h)) for h in holes)
    if not np.isclose(sum(abs(area(x)) for x in t), want, rtol=AREA_RTOL, atol=1e-9):
        raise ValueError("triangles do not fill the polygon")
    return t[np.array([abs(area(x)) > 1e-12 for x in t])]


def outer_rings(polygons: list[np.ndarray], digits: int = 6) -> list[np.ndarray]:
    """Outer boundaries of patches that share whole edges: shared edges cancel, the rest is chained.

    Sorted by area, largest first. Patches that overlap or share parts of edges are not supported."""
    edges: dict[tuple, tuple] = {}
    for p in polygons:
        p = p if area(p) > 0 else p[::-1]
        q = [tuple(x) for x in np.round(p, digits)]
        for a, b in zip(q, q[1:] + q[:1], strict=True):
            if (b, a) in edges:
                del edges[(b, a)]
            elif (a, b) in edges:
                raise ValueError("patches overlap")
            else:
                edges[(a, b)] = (a, b)
    nxt: dict[tuple, list[tuple]] = {}
    for a, b in sorted(edges):
        nxt.setdefault(a, []).append(b)
    rings = []
    while nxt:
        start = min(nxt)
        ring, here = [start], start
        while True:
            there = nxt[here].pop(0)
            if not nxt[here]:
                del nxt[here]
            if there == start:
                break
            ring.append(there)
            here = there
            if here not in nxt:
                raise ValueError("boundary is open")
        rings.append(np.array(ring))
    return sorted((r for r in rings if area(r) > 0), key=lambda r: (-area(r), r.min(axis=0).tolist()))


def per_group(df: DataFrame, key: str, columns: list[str], f, fields: str) -> DataFrame:
    """f(numpy array of columns, by ord) -> dict of doubles for each key; ValueError becomes `error`."""
    names = [x.split()[0] for x in fields.split(", ")]
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {fields}, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("rows")
            ends, rows = np.asarray(lists.offsets), lists.values
            values = np.stack([rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            out, errors = [], []
            for i in range(len(lists)):
                try:
                    out.append(f(values[ends[i] : ends[i + 1]]))
                    errors.append(None)
                except ValueError as e:
                    out.append({})
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.get(n) for r in out], pa.float64(), from_pandas=True) for n in names), pa.array(errors, pa.string())], [key, *names, "error"])

    rows = dealt(df.select(key, "ord", *columns), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", *columns))).alias("rows"))
    return rows.mapInArrow(run, schema)


class Gaps:
    """Distances |a - b| / scale of all pairs of finite values with the same code, ordered without making the pairs.

    With a code's b sorted, the b within a distance of an a are one run, so pairs up to a distance are counted by binary
    search with the distances themselves. Memory grows with the values, not with the pairs."""

    def __init__(self, codes_a: np.ndarray, a: np.ndarray, codes_b: np.ndarray, b: np.ndarray, scale: float = 1.0):
        order = np.lexsort((a, codes_a))  # neighbours look in the same places
        self.a, codes_a = a[order], codes_a[order]
        order = np.lexsort((b, codes_b))
        self.b, self.scale, codes = b[order], scale, codes_b[order]
        self.start, self.end = np.searchsorted(codes, codes_a, "left"), np.searchsorted(codes, codes_a, "right")
        self.middle = self._first(self.start, self.end, lambda i, j: self.b[j] >= self.a[i])
        self.n = int((self.end - self.start).sum())

    @staticmethod
    def _first(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
        """For each a the first place in [low, high) from which on it holds, else high."""
        low, high = low.copy(), high.copy()
        while (i := np.flatnonzero(low < high)).size:
            j = (low[i] + high[i]) // 2
            yes = holds(i, j)
            high[i[yes]], low[i[~yes]] = j[yes], j[~yes] + 1
        return low

    def gap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.abs(self.a[i] - self.b[j]) / self.scale

    def _upto(self, limit: float, inner: tuple[np.ndarray, np.ndarray], outer: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The run of b within the limit of each a, known to lie between two others."""
        return self._first(outer[0], inner[0], lambda i, j: self.gap(i, j) <= limit), self._first(inner[1], outer[1], lambda i, j: self.gap(i, j) > limit)

    def nth(self, k: int) -> tuple[float, float]:
        """The k-th least distance, from 0, and the one after it (the last: itself).

        Distances drawn from those still open only say where to cut; what is cut off is counted, so the result is exact."""
        rng = np.random.default_rng(0)
        low, inner = -1.0, (self.middle, self.middle)
        high, outer = np.inf, (self.start, self.end)
        close = False
        while True:
            below, upto = (int((r - l).sum()) for l, r in (inner, outer))
            if math.nextafter(low, math.inf) >= high:
                return high, high if k + 1 < upto or upto == self.n else self._after(outer)
            first, sizes = np.concatenate([outer[0], inner[1]]), np.concatenate([inner[0] - outer[0], outer[1] - inner[1]])
            ends = np.cumsum(sizes)
            open_ = upto - below
            at = np.arange(open_) if open_ <= PAIRS_AT_ONCE else np.sort(rng.integers(0, open_, PAIRS_TRIED))
            row = np.searchsorted(ends, at, "right")
            gaps = self.gap(row % len(self.a), first[row] + at - (ends - sizes)[row])
            gaps.sort()
            if open_ <= PAIRS_AT_ONCE:
                k -= below
                return float(gaps[k]), float(gaps[k + 1]) if k + 1 < open_ else float(gaps[k]) if upto == self.n else self._after(outer)
            near = (k - below) / open_ * len(gaps)
            wide = 0 if close else 4 * np.sqrt(len(gaps)) / 2 + 1
            cuts = [math.nextafter(gaps[max(0, int(near - wide))], -math.inf), gaps[min(len(gaps) - 1, int(near + wide))]]
            for cut in cuts:
                if not low < cut < high:
                    continue
                run = self._upto(cut, inner, outer)
                if k < int((run[1] - run[0]).sum()):
                    high, outer = cut, run
                else:
                    low, inner = cut, run
            close = int((outer[1] - outer[0]).sum() - (inner[1] - inner[0]).sum()) == open_

    def _after(self, outer: tuple[np.ndarray, np.ndarray]) -> float:
        """The least distance outside the runs."""
        i, j = np.flatnonzero(outer[0] > self.start), np.flatnonzero(outer[1] < self.end)
        return float(min(self.gap(i, outer[0][i] - 1).min(initial=np.inf), self.gap(j, outer[1][j]).min(initial=np.inf)))


def gap_percentiles(a: DataFrame, b: DataFrame, key: str, match: str, value: str, shares: tuple[float, ...], scale: float = 1.0) -> DataFrame:
    """For each key, over all pairs of its rows of a and of b with equal `match`: n, the number of distances
    |a - b| / scale that are not null, and `at`, their percentiles (linear), with NaN above infinity. No pairs: no row.

    Pairs are counted, not made (see Gaps): a task holds the rows of one key."""

    def codes(tables: list[pa.Table]) -> list[np.ndarray]:
        parts = [t.column("m").to_numpy() for t in tables]
        _, both = np.unique(np.concatenate(parts), return_inverse=True)
        return np.split(both, [len(parts[0])])

    def counts(code: np.ndarray, size: int, v: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(code[w], minlength=size) for w in (v == v, v == np.inf, v == -np.inf)]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out = {"k": [], "n": [], "at": []}
        codes_x, codes_y = codes([x, y]) if x.num_rows and y.num_rows else (np.empty(0, int), np.empty(0, int))
        if np.intersect1d(codes_x, codes_y).size:
            size = int(max(codes_x.max(), codes_y.max())) + 1
            sides = [(c[w], t.column("v").to_numpy()[w]) for c, t in ((codes_x, x), (codes_y, y)) for w in [t.column("v").is_valid().to_numpy()]]
            number = int(np.dot(*[np.bincount(c, minlength=size) for c, _ in sides]))
            (real_x, up_x, down_x), (real_y, up_y, down_y) = (counts(c, size, v) for c, v in sides)
            real = int(real_x @ real_y - up_x @ up_y - down_x @ down_y)  # infinity less infinity is no number
            (c, v), (d, w) = ((c[np.isfinite(v)], v[np.isfinite(v)]) for c, v in sides)
            gaps = Gaps(c, v, d, w, scale)

            def nth(k: int) -> tuple[float, float]:
                beyond = lambda i: np.inf if i < real else np.nan
                if k >= gaps.n:
                    return beyond(k), beyond(k + 1)
                here, after = gaps.nth(k)
                return here, after if k + 1 < gaps.n else beyond(k + 1)

            at = []
            for share in shares if number else ():
                place = (number - 1) * share
                k = int(place)
                here, after = nth(k)
                at.append(here if place == k or here == after else (k + 1 - place) * here + (place - k) * after)
            out = {"k": [x.column("k")[0].as_py()], "n": [number], "at": [at or None]}
        return pa.table(out, schema=pa.schema([x.schema.field("k"), ("n", pa.int64()), ("at", pa.list_(pa.float64()))]))

    kind = a.schema[key].dataType.simpleString()
    x, y = (t.where(f"`{match}` IS NOT NULL AND `{key}` IS NOT NULL").selectExpr(f"`{key}` AS k", f"`{match}` AS m", f"CAST(`{value}` AS DOUBLE) AS v").groupBy("k") for t in (a, b))
    return x.cogroup(y).applyInArrow(run, f"k {kind}, n long, at array<double>").withColumnRenamed("k", key)
