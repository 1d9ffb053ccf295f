"""Overlay of polygons: union, difference, intersection and repair by one arrangement of their edges.

Coordinates are snapped to a fine grid. Edges are split where they cross and at each vertex within a grid step of them, until
nothing is left to split; edges sorted by their left ends are compared only with those that begin before they end. On either
side of each remaining piece it is then known which polygons hold it, by counting pieces to its right; pieces with the result
on one side only are its boundary, and are chained to rings. Partly shared edges, touching corners, holes and rings that cross
themselves need no cases of their own.

A polygon is a list of rings under the even-odd rule, so the order and sense of rings do not matter. One group (a wall's
patches) is one arrangement; its size is bounded by the polygons of one wall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import area, inside

SNAP = 1e-6
"""The grid's step in the units of the coordinates."""
NEAR = 0.75
"""Grid steps within which a vertex is on an edge."""
ROUNDS = 50
BLOCK = 512
MANY = 256
"""Edges up to which a group is worked together with others."""
LOT = 1 << 17
"""Squares of edges that are worked at once."""

Polygon = tuple[np.ndarray, list[np.ndarray]]
"""Outer ring, counter-clockwise, and holes, clockwise."""


def _blocks(e: np.ndarray):
    """Blocks of edges sorted by their left ends, and how many edges begin before each block ends."""
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for i in range(0, len(e), BLOCK):
        yield slice(i, i + BLOCK), int(np.searchsorted(left, right[i : i + BLOCK].max() + 2, "right"))


def _crossings(e: np.ndarray) -> np.ndarray:
    """Grid points next to the proper crossings of edges (n, 4), which are sorted by their left ends."""
    out = [np.empty((0, 2))]
    for rows, stop in _blocks(e):
        a, b, c, d = e[rows, None, :2], e[rows, None, 2:], e[None, :stop, :2], e[None, :stop, 2:]
        p, q, g = b - a, d - c, c - a
        den = p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (g[..., 0] * q[..., 1] - g[..., 1] * q[..., 0]) / den, (g[..., 0] * p[..., 1] - g[..., 1] * p[..., 0]) / den
        i, j = np.nonzero((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        out.append(np.rint(a[i, 0] + t[i, j, None] * p[i, 0]))
    return np.unique(np.concatenate(out), axis=0)


def _split(e: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and their polygons after splitting at all crossings and vertices near them."""
    for _ in range(ROUNDS):
        order = np.argsort(np.minimum(e[:, 0], e[:, 2]), kind="stable")
        e, of = e[order], of[order]
        v = np.unique(np.concatenate([e[:, :2], e[:, 2:], _crossings(e)]), axis=0)
        pieces, owners, changed = [], [], False
        for i in range(0, len(e), BLOCK):
            part = e[i : i + BLOCK]
            lo, hi = np.searchsorted(v[:, 0], part[:, [0, 2]].min() - 1), np.searchsorted(v[:, 0], part[:, [0, 2]].max() + 1, "right")
            a, d, w = part[:, None, :2], part[:, None, 2:] - part[:, None, :2], v[None, lo:hi]
            t = ((w - a) * d).sum(axis=2) / np.maximum((d * d).sum(axis=2), 1e-300)
            off = np.sqrt((((w - a) - np.clip(t, 0, 1)[..., None] * d) ** 2).sum(axis=2))
            end = ((w == a).all(axis=2)) | ((w == a + d).all(axis=2))
            on = (off <= NEAR) & ~end & (t > 0) & (t < 1)
            for k in range(len(part)):
                at = np.flatnonzero(on[k])
                if len(at):
                    changed = True
                    at = at[np.argsort(t[k, at], kind="stable")]
                    chain = np.concatenate([part[k, None, :2], v[lo + at], part[k, None, 2:]])
                    pieces.append(np.concatenate([chain[:-1], chain[1:]], axis=1))
                else:
                    pieces.append(part[k : k + 1])
                owners.append(np.full(len(pieces[-1]), of[i + k]))
        e, of = np.concatenate(pieces), np.concatenate(owners)
        keep = (e[:, :2] != e[:, 2:]).any(axis=1)
        e, of = e[keep], of[keep]
        if not changed:
            return e, of
    raise ValueError("edges do not settle on the grid")


class Arrangement:
    """Pieces of edges (n, 4), each once from its lesser to its greater end, and which polygons have it as an edge."""

    def __init__(self, polygons: list[list[np.ndarray]], snap: float = SNAP):
        rings = [(k, np.asarray(r, float)) for k, p in enumerate(polygons) for r in p]
        if not rings or not all(np.isfinite(r).all() for _, r in rings):
            raise ValueError("no finite ring")
        self.n, self.snap = len(polygons), snap
        self.shift = np.concatenate([r for _, r in rings]).min(axis=0)
        edges, of = [], []
        for k, r in rings:
            q = np.rint((r - self.shift) / snap)
            edges.append(np.concatenate([q, np.roll(q, -1, axis=0)], axis=1))
            of.append(np.full(len(q), k))
        e, of = np.concatenate(edges), np.concatenate(of)
        keep = (e[:, :2] != e[:, 2:]).any(axis=1)
        if not keep.any():
            raise ValueError("no ring with an extent")
        e, of = _split(e[keep], of[keep])
        back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
        e[back] = e[back][:, [2, 3, 0, 1]]
        self.edges, at = np.unique(e, axis=0, return_inverse=True)
        times = np.zeros((len(self.edges), self.n), dtype=np.int64)
        np.add.at(times, (at.ravel(), of), 1)
        self.own = times % 2 == 1
        real = self.own.any(axis=1)  # what a polygon passes twice bounds nothing
        self.edges, self.own = self.edges[real], self.own[real]
        self._sides = None

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Which polygons hold the points just right and just left of each piece (seen from its lesser end)."""
        e = self.edges
        right = np.zeros((len(e), self.n), dtype=bool)
        level = e[:, 1] == e[:, 3]
        for axis, mine in ((0, ~level), (1, level)):  # rays along x; for level pieces along y
            a, b = e[:, [axis, 1 - axis]], e[:, [2 + axis, 3 - axis]]
            rows = np.flatnonzero(mine)
            for i in range(0, len(rows), BLOCK):
                r = rows[i : i + BLOCK]
                m = (a[r] + b[r]) / 2
                spans = (a[None, :, 1] > m[:, None, 1]) != (b[None, :, 1] > m[:, None, 1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = a[None, :, 0] + (m[:, None, 1] - a[None, :, 1]) * (b[None, :, 0] - a[None, :, 0]) / (b[None, :, 1] - a[None, :, 1])
                beyond = spans & (x > m[:, None, 0])
                beyond[np.arange(len(r)), r] = False
                ahead = (beyond.astype(float) @ self.own.astype(float)) % 2 == 1  # on the side of greater x (level: y)
                # the lesser end is left or below: greater x is right of a piece that goes up, and left of one that goes down
                upward = (e[r, 3] > e[r, 1]) if axis == 0 else np.zeros(len(r), dtype=bool)
                right[r] = np.where(upward[:, None], ahead, ahead ^ self.own[r])
        return right, right ^ self.own

    def region(self, rule: Callable[[np.ndarray], np.ndarray]) -> list[Polygon]:
        """The region of the points for which rule (of a boolean row by polygon) holds, largest polygon first."""
        right, left = self._sides = self._sides or self.sides()
        r, l = rule(right), rule(left)
        # the region lies to the left of each directed piece
        go = np.concatenate([self.edges[l & ~r], self.edges[r & ~l][:, [2, 3, 0, 1]]])
        rings = [(q * self.snap + self.shift) for loop in _loops(go) for q in [loop]]
        outer = sorted((x for x in rings if area(x) > 0), key=lambda x: (-area(x), x.min(axis=0).tolist()))
        holes: list[list[np.ndarray]] = [[] for _ in outer]
        for h in (x for x in rings if area(x) < 0):
            middle = (h[0] + h[1]) / 2
            around = [i for i, x in enumerate(outer) if inside(middle[None], x)[0] and area(x) > -area(h)]
            if around:
                holes[around[-1]].append(h)  # the smallest that holds it
        return list(zip(outer, holes, strict=True))


def _loops(go: np.ndarray) -> list[np.ndarray]:
    """Simple rings of directed pieces, keeping the region on the left: at each vertex the next piece is the first one
    clockwise from where the ring comes from; rings that pass a vertex twice are parted there."""
    leaving: dict[tuple, list[tuple[float, tuple]]] = {}
    for a, b, c, d in go.tolist():
        leaving.setdefault((a, b), []).append((float(np.arctan2(d - b, c - a)), (c, d)))
    out = []
    for start in sorted(leaving):
        while leaving.get(start):
            path, here, back = [start], start, None
            while True:
                ways = leaving[here]
                pick = 0 if back is None else min(range(len(ways)), key=lambda i: (back - ways[i][0]) % (2 * np.pi) or 2 * np.pi)  # noqa: B023
                angle, there = ways.pop(pick)
                back = float(np.arctan2(-np.sin(angle), -np.cos(angle)))
                if there == start and not (leaving.get(start) and len(path) < 2):
                    break
                path.append(there)
                here = there
            stack: list[tuple] = []
            place: dict[tuple, int] = {}
            for p in path:
                if p in place:
                    k = place[p]
                    out.append(np.array(stack[k:]))
                    for q in stack[k + 1 :]:
                        del place[q]
                    del stack[k + 1 :]
                else:
                    place[p] = len(stack)
                    stack.append(p)
            out.append(np.array(stack))
    return [_straight(r) for r in out if len(r) > 2]


def _straight(r: np.ndarray) -> np.ndarray:
    """Without corners on a straight line between their neighbours."""
    a, b = np.roll(r, 1, axis=0), np.roll(r, -1, axis=0)
    turn = (r[:, 0] - a[:, 0]) * (b[:, 1] - r[:, 1]) - (r[:, 1] - a[:, 1]) * (b[:, 0] - r[:, 0])
    return r[turn != 0] if (turn != 0).sum() > 2 else r


def union(polygons: list[list[np.ndarray]]) -> list[Polygon]:
    return Arrangement(polygons).region(lambda m: m.any(axis=1))


def intersection(polygons: list[list[np.ndarray]]) -> list[Polygon]:
    return Arrangement(polygons).region(lambda m: m.all(axis=1))


def difference(polygon: list[np.ndarray], others: list[list[np.ndarray]]) -> list[Polygon]:
    return Arrangement([polygon, *others]).region(lambda m: m[:, 0] & ~m[:, 1:].any(axis=1))


def repaired(outer: np.ndarray, holes: list[np.ndarray]) -> list[Polygon]:
    """What a ring bounds, less what its holes bound, whichever cross themselves, each other or the outer ring."""
    return difference([outer], [[h] for h in holes])


def simple(ring: np.ndarray) -> bool:
    """Whether a ring bounds one piece without touching or crossing itself."""
    try:
        found = union([[ring]])
    except ValueError:
        return False
    return len(found) == 1 and not found[0][1] and bool(np.isclose(area(found[0][0]), abs(area(np.asarray(ring, float))), rtol=1e-9, atol=1e-9))


def size(polygons: list[Polygon]) -> float:
    return float(sum(area(o) + sum(area(h) for h in holes) for o, holes in polygons))


_size = size

OPERATIONS = {"union": union, "intersection": intersection, "difference": lambda p: difference(p[0], p[1:])}


def _gathered(polygons: DataFrame, key: str) -> DataFrame:
    return polygons.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "rings"))).alias("polygons")).select(key, "polygons.rings")


def _given(polygons: list, checked: bool) -> list[list[np.ndarray]]:
    out = [[np.array([(p["x"], p["y"]) for p in r], dtype=float).reshape(-1, 2) for r in rings] for rings in polygons]
    if checked and not all(p and simple(p[0]) for p in out):
        raise ValueError("ring is not simple")
    return out


def overlay(polygons: DataFrame, key: str, operation: str, checked: bool = False) -> DataFrame:
    """(key, part, outer, holes, area, error): the polygons of the result for each key, largest first.

    polygons (key, ord, rings: array of arrays of structs x, y); the difference is of the first by ord less the others.
    checked: a polygon whose first ring is not simple makes an error row, as do keys that cannot be solved; an empty result
    has no row."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    told = lambda r: [{"x": a, "y": b} for a, b in r.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, given in enumerate(batch.column(1).to_pylist()):
                try:
                    found = OPERATIONS[operation](_given(given, checked))
                    rows += [(i, k, told(o), [told(h) for h in holes], size([(o, holes)]), None) for k, (o, holes) in enumerate(found)]
                except ValueError as e:
                    rows.append((i, None, None, None, None, str(e)))
            at, *columns = zip(*rows, strict=True) if rows else ((),) * 6
            types = (pa.int32(), pa.list_(point), pa.list_(pa.list_(point)), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "part", "outer", "holes", "area", "error"])

    ring = "array<struct<x: double, y: double>>"
    return _gathered(polygons, key).mapInArrow(run, f"`{key}` {polygons.schema[key].dataType.simpleString()}, part int, outer {ring}, holes array<{ring}>, area double, error string")


def _reach(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with first[i] <= j < last[i]."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by columns, the first of them first, and where in it new rows begin."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]) if len(order) else new[1:]
    return order, np.flatnonzero(new)


def _split_all(e: np.ndarray, of: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_split for the edges of many groups at once, and the groups that do not settle."""
    done, wide = [], float(np.abs(e).max() + 8)
    for _ in range(ROUNDS):
        order = np.lexsort((np.minimum(e[:, 0], e[:, 2]), g))
        e, of, g = e[order], of[order], g[order]
        low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        key = g * (2 * wide) + low[:, 0]
        i, j = _reach(np.arange(len(e)) + 1, np.searchsorted(key, g * (2 * wide) + high[:, 0] + 2, "right"))
        near = (low[i, 1] <= high[j, 1] + 2) & (low[j, 1] <= high[i, 1] + 2)
        i, j = np.concatenate([i[near], j[near]]), np.concatenate([j[near], i[near]])
        a, c = e[i, :2], e[j, :2]
        p, q, d = e[i, 2:] - a, e[j, 2:] - c, c - a
        den = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, u = (d[:, 0] * q[:, 1] - d[:, 1] * q[:, 0]) / den, (d[:, 0] * p[:, 1] - d[:, 1] * p[:, 0]) / den
        k = np.flatnonzero((den != 0) & (s > 0) & (s < 1) & (u > 0) & (u < 1))
        v = np.concatenate([e[:, :2], e[:, 2:], np.rint(a[k] + s[k, None] * p[k])])
        vg = np.concatenate([g, g, g[i[k]]])
        order, new = _distinct(vg, v[:, 0], v[:, 1])
        v, vg = v[order[new]], vg[order[new]]
        key = vg * (2 * wide) + v[:, 0]
        i, j = _reach(np.searchsorted(key, g * (2 * wide) + low[:, 0] - 1), np.searchsorted(key, g * (2 * wide) + high[:, 0] + 1, "right"))
        near = (v[j, 1] >= low[i, 1] - 1) & (v[j, 1] <= high[i, 1] + 1)
        i, j = i[near], j[near]
        a, d, w = e[i, :2], e[i, 2:] - e[i, :2], v[j]
        at = ((w - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300)
        off = np.sqrt((((w - a) - np.clip(at, 0, 1)[:, None] * d) ** 2).sum(axis=1))
        end = (w == a).all(axis=1) | (w == a + d).all(axis=1)
        on = (off <= NEAR) & ~end & (at > 0) & (at < 1)
        n = len(e)
        edge, at, stop = np.concatenate([np.arange(n), np.arange(n), i[on]]), np.concatenate([np.full(n, -1.0), np.full(n, 2.0), at[on]]), np.concatenate([e[:, :2], e[:, 2:], v[j[on]]])
        order = np.lexsort((at, edge))
        edge, stop = edge[order], stop[order]
        k = np.flatnonzero(edge[1:] == edge[:-1])
        changed = np.zeros(g.max(initial=0) + 1, dtype=bool)
        changed[g[i[on]]] = True
        e, of, g = np.concatenate([stop[k], stop[k + 1]], axis=1), of[edge[k]], g[edge[k]]
        keep = (e[:, :2] != e[:, 2:]).any(axis=1)
        e, of, g = e[keep], of[keep], g[keep]
        again = changed[g]
        done.append((e[~again], of[~again], g[~again]))
        e, of, g = e[again], of[again], g[again]
        if not len(e):
            break
    return *(np.concatenate(c) for c in zip(*done, strict=True)), np.unique(g)


def _beyond(e: np.ndarray, own: np.ndarray, g: np.ndarray, axis: int, rows: np.ndarray) -> np.ndarray:
    """Which polygons (as bits) hold the points just beside the middle of the pieces `rows`, seen along an axis."""
    a, b = e[:, [axis, 1 - axis]], e[:, [2 + axis, 3 - axis]]
    met = np.flatnonzero(a[:, 1] != b[:, 1])
    i, j = _reach(np.searchsorted(g[met], g[rows]), np.searchsorted(g[met], g[rows], "right"))
    r, s = rows[i], met[j]
    m = (a[r] + b[r]) / 2
    spans = np.flatnonzero(((a[s, 1] > m[:, 1]) != (b[s, 1] > m[:, 1])) & (r != s))
    i, s, m = i[spans], s[spans], m[spans]
    x = a[s, 0] + (m[:, 1] - a[s, 1]) * (b[s, 0] - a[s, 0]) / (b[s, 1] - a[s, 1])
    out = np.zeros(len(rows), dtype=np.uint64)
    np.bitwise_xor.at(out, i[x > m[:, 0]], own[s[x > m[:, 0]]])
    return out


def _areas_of(e: np.ndarray, of: np.ndarray, g: np.ndarray, held: np.ndarray, snap: float = SNAP) -> tuple[np.ndarray, np.ndarray]:
    """Areas (groups, 3) of union, intersection and first less others of many groups' polygons, and the groups that do not settle.

    e: edges on the grid, of: their polygon (below 64), g: their group, held: polygons of each group."""
    e, of, g, open_ = _split_all(e, of, g)
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[back] = e[back][:, [2, 3, 0, 1]]
    order, new = _distinct(g, *e.T)
    bit = np.left_shift(np.uint64(1), of.astype(np.uint64))[order]
    own = np.bitwise_xor.reduceat(bit, new) if len(new) else bit  # what a polygon passes twice bounds nothing
    e, g = e[order[new]], g[order[new]]
    e, g, own = e[own != 0], g[own != 0], own[own != 0]
    level = e[:, 1] == e[:, 3]
    right = np.zeros(len(e), dtype=np.uint64)
    for axis, rows in ((0, np.flatnonzero(~level)), (1, np.flatnonzero(level))):
        ahead = _beyond(e, own, g, axis, rows)
        upward = (e[rows, 3] > e[rows, 1]) if axis == 0 else np.zeros(len(rows), dtype=bool)
        right[rows] = np.where(upward, ahead, ahead ^ own[rows])
    left, full = right ^ own, (np.left_shift(np.uint64(1), held.astype(np.uint64)) - np.uint64(1))[g]
    half = (e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]) / 2 * snap * snap
    sides = [(rule(left).astype(int) - rule(right)) * half for rule in (lambda m: m != 0, lambda m: m == full, lambda m: m == 1)]
    return np.stack([np.bincount(g, s, len(held)) for s in sides], axis=1), open_


def _areas(column: pa.ListArray) -> tuple[np.ndarray, list[str | None]]:
    """Areas (rows, 3) of each row's polygons (see areas), NaN where there is an error, and errors."""
    polygons = column.values
    rings = polygons.values
    points = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in rings.values.flatten()], axis=1)
    by_row, by_polygon, by_ring = (np.asarray(c.offsets).astype(np.int64) for c in (column, polygons, rings))
    n = len(column)
    row = np.repeat(np.arange(n), np.diff(by_row))
    ring_polygon = np.repeat(np.arange(len(row)), np.diff(by_polygon[by_row[0] : by_row[-1] + 1]))
    first = by_ring[by_polygon[by_row[0]] : by_polygon[by_row[-1]] + 1]
    ring = np.repeat(np.arange(len(ring_polygon)), np.diff(first))
    here = np.arange(first[0], first[-1])
    after = np.where(here + 1 == first[1:][ring], first[:-1][ring], here + 1) - first[0]
    points, g = points[first[0] : first[-1]], row[ring_polygon[ring]]
    of, held = ring_polygon[ring] - (by_row - by_row[0])[g], np.diff(by_row)
    bad = np.zeros(n, dtype=bool)
    bad[g[~np.isfinite(points).all(axis=1)]] = True
    bad |= np.bincount(row[ring_polygon], minlength=n) == 0
    least = np.full((n, 2), np.inf)
    np.minimum.at(least, g, points)
    with np.errstate(invalid="ignore"):
        q = np.rint((points - least[g]) / SNAP)
    e = np.concatenate([q, q[after]], axis=1)
    keep = ~bad[g] & (q != q[after]).any(axis=1)
    e, of, g = e[keep], of[keep], g[keep]
    size = np.bincount(g, minlength=n)
    errors = [None if s else "no finite ring" if b else "no ring with an extent" for s, b in zip(size, bad, strict=True)]
    out = np.full((n, 3), np.nan)
    small = (size > 0) & (size <= MANY) & (held < 64)
    lots = np.cumsum(np.where(small, size * size, 0)) // LOT
    ends = np.searchsorted(g, np.arange(n + 1))
    for rows in np.split(np.arange(n), np.flatnonzero(np.diff(lots)) + 1) if n else ():
        part = slice(ends[rows[0]], ends[rows[-1] + 1])
        mine = small[g[part]]
        if mine.any():
            found, unsettled = _areas_of(e[part][mine], of[part][mine], g[part][mine] - rows[0], held[rows])
            out[rows[small[rows]]] = found[small[rows]]
            for k in unsettled + rows[0]:
                out[k], errors[k] = np.nan, "edges do not settle on the grid"
    for k in np.flatnonzero((size > 0) & ~small):
        try:
            a = Arrangement(_given(column[int(k)].as_py(), False))
            out[k] = [_size(a.region(rule)) for rule in (lambda m: m.any(axis=1), lambda m: m.all(axis=1), lambda m: m[:, 0] & ~m[:, 1:].any(axis=1))]
        except ValueError as x:
            errors[k] = str(x)
    return out, errors


def areas(polygons: DataFrame, key: str) -> DataFrame:
    """(key, union_area, common_area, first_only_area, error) from one arrangement of each key's polygons (see overlay).

    An area is the sum over the region's boundary pieces, so no rings are made; the arrangements of many small groups (up to
    MANY edges) are worked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = _areas(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, mask=np.isnan(c)) for c in out.T), pa.array(errors, pa.string())], [key, "union_area", "common_area", "first_only_area", "error"])

    return _gathered(polygons, key).mapInArrow(run, f"`{key}` {polygons.schema[key].dataType.simpleString()}, union_area double, common_area double, first_only_area double, error string")


def wall_outlines(patches: DataFrame, key: str = "wall_id") -> DataFrame:
    """The outer boundaries of each wall's patches (key, ord, rings) as rings for mapping: key, ring_id, points, error."""
    return overlay(patches, key, "union", checked=True).select(key, F.col("part").alias("ring_id"), F.col("outer").alias("points"), "error")
