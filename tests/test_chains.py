"""Composed queries against plain loops over the collected tables."""

import math
from collections import Counter

import numpy as np
import pytest
from test_mapping import plain_inside

from quoin.operators import guided as T
from quoin.operators import mapping as G
from quoin.plans import chains

SF = "/root/testdata/sf0.001"


def hit(px, py, r):
    m = np.array(r.camera).reshape(4, 4)
    o, u, v = (np.array(x) for x in (r.origin, r.u, r.v))
    n, d = np.cross(u, v), m[:3, 2]
    p = m[:3, 0] * px + m[:3, 1] * py + m[:3, 3]
    if abs(d @ n) < np.linalg.norm(d) * np.linalg.norm(n) * 1e-4:
        return None
    depth = (o - p) @ n / (d @ n)
    q = p + depth * d - o
    return (float(q @ u), float(q @ v)) if depth > 0 else None


def judged(d, r, rings, pixel, wall_of):
    """The reason against a detection of a sound run, or None."""
    box = (d.x0, d.y0, d.x1, d.y1)
    if d["class"] not in ("window", "door", "ambiguous"):
        return G.REASONS[0]
    if not (all(map(math.isfinite, box)) and d.x1 > d.x0 and d.y1 > d.y0):
        return G.REASONS[1]
    if d.x0 < 0 or d.y0 < 0 or d.x1 > r.photo_w or d.y1 > r.photo_h:
        return G.REASONS[2]
    if d.x0 <= 1e-6 or d.y0 <= 1e-6 or d.x1 >= r.photo_w - 1e-6 or d.y1 >= r.photo_h - 1e-6:
        return G.REASONS[3]
    h = np.array(r.h).reshape(3, 3)
    to = lambda x, y: h @ (x, y, 1.0)
    corners = [to(d.x0, d.y0), to(d.x1, d.y0), to(d.x1, d.y1), to(d.x0, d.y1)]
    if not (all(c[2] > 0 for c in corners) or all(c[2] < 0 for c in corners)):
        return G.REASONS[4]
    render = [(c[0] / c[2], c[1] / c[2]) for c in corners]
    if not all(-0.5 <= x < r.render_w - 0.5 and -0.5 <= y < r.render_h - 0.5 for x, y in render):
        return G.REASONS[5]
    uv = [hit(x, y, r) for x, y in render]
    if None in uv:
        return G.REASONS[6]
    if abs(sum(uv[i][0] * uv[(i + 1) % 4][1] - uv[(i + 1) % 4][0] * uv[i][1] for i in range(4))) / 2 < 1e-6:
        return G.REASONS[7]
    if not any(plain_inside(uv, ring, 0.03) for ring in rings.get(r.wall_id, [])):
        return G.REASONS[8]
    seen, middle = Counter(), None
    for i in range(25):
        c = to(d.x0 + (0.1 + i % 5 * 0.2) * (d.x1 - d.x0), d.y0 + (0.1 + i // 5 * 0.2) * (d.y1 - d.y0))
        o = pixel.get((r.view_id, math.floor(c[0] / c[2] + 0.5), math.floor(c[1] / c[2] + 0.5)))
        kind = "none" if o is None else "same" if wall_of.get((r.building_id, o)) == r.wall_id else "other"
        seen[kind] += 1
        middle = kind if i == 12 else middle
    return None if middle == "same" and seen["same"] >= 20 and seen["other"] <= 1 else G.REASONS[9]


@pytest.fixture(scope="module")
def chain(spark):
    det, runs, rings, pixels, objects = (t.collect() for t in chains.mapping_tables(spark, SF))
    return det, {r.run: r for r in runs}, rings, pixels, objects


def test_mapping_chain(spark, chain):
    det, runs, rings, pixels, objects = chain
    pixel = {(p.view_id, p.x, p.y): p.object_index for p in pixels}
    wall_of = {(o.building_id, o.object_index): o.wall_id for o in objects if o.kind in ("WallSurface", "Window", "Door")}
    outlines = {}
    for r in rings:
        outlines.setdefault(r.wall_id, []).append([(p.x, p.y) for p in r.points])
    seen = {}
    for p in pixels:
        seen.setdefault(p.view_id, set()).add(p.object_index)
    got = {(r.run, r.ord): r for r in chains.mapping_chain(spark, SF).collect()}
    assert len(got) == len(det)
    reasons = Counter()
    for d in det:
        r = runs[d.run]
        visible = any(wall_of.get((r.building_id, o)) == r.wall_id for o in seen.get(r.view_id, ()))
        want = judged(d, r, outlines, pixel, wall_of) if visible else "wall_not_visible_in_view"
        assert got[d.run, d.ord].reject_reason == want, (d, r)
        reasons[want] += 1
    assert {None, *G.REASONS} <= set(reasons)
    status = {r.run: r for r in chains.mapping_statuses(spark, SF).collect()}
    mapped = Counter(d.run for d in det if got[d.run, d.ord].reject_reason is None)
    assert {k: r.mapped for k, r in status.items()} == {k: mapped[k] for k in {d.run for d in det}}
    assert all(r.status == ("preview_created" if r.mapped else "no_detections_mapped") for r in status.values())


def test_guided_tiles_meet_all_reachable_reasons(spark):
    got = {r.skip_reason for r in chains.guided_tiles(spark, SF).collect()}
    assert got == {None, *T.REASONS} - {T.REASONS[1]}


@pytest.mark.parametrize("name", sorted(chains.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    import os

    import duckdb
    from test_catalogue import rows

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df, rel = chains.QUERIES[name](spark, SF), con.sql(chains.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert rows(names, [r.asDict() for r in df.collect()]) == rows(names, [dict(zip(rel.columns, r)) for r in rel.fetchall()])
