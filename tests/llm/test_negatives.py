"""Hard negatives against plain loops: ties, copies, odd rows, large numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.llm import op11_negatives as N
from quoin.llm.vectors import inner, matrix

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string, place int"


def plain(rows, anchor, moved, k_positives, k, low, high):
    held = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * x) for x in v], moved(i, label)))
    out = []
    for at, (i, a, label) in enumerate(held):
        if not anchor(i):
            continue
        every = [(-sum(p * q for p, q in zip(a, x)), j, other) for n, (j, x, other) in enumerate(held) if n != at]
        for s, j, _ in sorted(e for e in every if e[2] == label)[:k_positives]:
            window = sorted((n, m) for n, m, other in every if other != label and low * -s <= 100 * -n <= high * -s)
            out += [(i, j, rank + 1, m, -s, -n) for rank, (n, m) in enumerate(window[:k])]
    return sorted(out)


def case(kind):
    rng = random.Random(kind)
    unit = lambda n: [rng.gauss(0, 1) / math.sqrt(n) for _ in range(n)]
    if kind == "mixed":
        rows = [(i, unit(8), rng.randrange(3), "s", "i", 1) for i in range(900)]
        rows += [(None, unit(8), 1, "s", "i", 1), (700, None, 1, "s", "i", 1), (1400, [], 1, "s", "i", 1), (2100, [None] * 8, 1, "s", "i", 1)]
        rows += [(2800, [math.nan] * 8, 1, "s", "i", 1), (3500, [math.inf] * 8, 1, "s", "i", 1), (4200, unit(8), None, "s", "i", 1)]
        return rows + [(4900, unit(3), 0, "s", "i", 1), (5600, [0.0] * 8, 2, "s", "i", 1)] + rows[:1] * 2 + [(100, unit(8), 2, "s", "i", 1)]
    if kind == "copies":  # one vector holds most rows, many scores tie
        v = unit(4)
        return [(i, v if i % 3 else [round(x, 1) for x in unit(4)], i % 4, "s", "i", 1) for i in range(1200)]
    if kind == "tight":  # near copies, far closer than the rounding of distances
        v = unit(16)
        return [(i, [4 * x * (0.8 if i % 2 else 1) * (1 + 1e-9 * rng.random()) + (0.004 if rng.random() < 0.3 else 0) for x in v], i % 2, "s", "i", 1) for i in range(700)]
    if kind == "large":  # scores beyond 53 bits
        return [(i, [(7e5 if i % 2 else 1e6) + rng.randrange(9) for _ in range(32)], i % 4 // 2, "s", "i", 1) for i in range(300)]
    if kind == "few":
        return [(0, [1.0, 0.0], 1, "s", "i", 1), (5, [0.2, 0.1], 1, "s", "i", 1), (6, [-0.5, 0.0], 1, "s", "i", 1), (8, [0.4, 0.0], 2, "s", "i", 1)]
    return []


@pytest.mark.parametrize("kind", ["mixed", "copies", "tight", "large", "few", "none"])
def test_same_rows_as_plain_loops(spark, kind):
    rows = case(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(map(tuple, N.hard_negatives(df, F.col("vec_id") % 100 == 0, label).collect()))
    want = plain(rows, lambda i: i % 100 == 0, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x, 5, 10, 30, 90)
    assert got == want
    assert kind == "none" or got


def test_tree_bounds_hold():
    rng = np.random.default_rng(3)
    for n, d in ((1, 3), (64, 3), (65, 3), (1000, 5), (3000, 40)):
        x = np.floor(rng.normal(size=(n, d)) * 256)
        x[: n // 3] = x[0]
        tree, a = N.Tree(x), np.floor(rng.normal(size=(20, d)) * 256)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(n))
        square = (a * a).sum(axis=1)
        low, high = tree.bounds(a, square)
        for k, rows in enumerate(tree.leaves):
            s = np.sqrt(np.maximum(0, square[:, None] + tree.square - 2 * (a @ x[rows].T)))
            assert (low[:, k] <= s.min(axis=1) + 1e-3).all() and (high[:, k] >= s.max(axis=1) - 1e-3).all()


def test_pruning_leaves_leaves_out(monkeypatch):
    """In few dimensions most leaves are never compared."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.uniform(-1, 1, size=(8192, 3)) * 256)
    tree, seen = N.Tree(x), []
    monkeypatch.setattr(N, "inner", lambda a, b: (seen.append(len(a) * len(b)), inner(a, b))[1])
    ids, labels = np.arange(8192), np.zeros(8192, dtype=np.int64)
    hi = np.full(50, 20_000)
    row, other, score = N.first_k(tree, ids, labels, x[:50], ids[:50], labels[:50] + 1, hi - 15_000, hi, False, 10)
    assert sum(seen) < 50 * 8192 / 3
    for i in range(50):
        s = x @ x[i]
        best = sorted((-v, j) for j, v in enumerate(s.tolist()) if 5_000 <= v <= 20_000)[:10]
        assert [(-int(v), j) for v, j in best] == list(zip(score[row == i].tolist(), other[row == i].tolist()))


def test_inner_products_are_exact():
    import pyarrow as pa

    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [2.0**20 + 1, 5.0], [-(2.0**40), 0.0]])
    assert inner(a, b).tolist() == [[2**63 - 1, 2**60 + 2**40 + 15, -(2**63)]]
    m = matrix(pa.chunked_array([pa.array([[1.0], [2.0, 3.0]]), pa.array([[4.0, 5.0, 6.0]])]), 3)
    assert m.tolist() == [[1, 0, 0], [2, 3, 0], [4, 5, 6]]
