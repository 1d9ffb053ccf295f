"""Statistics and neighbours of pairs, found without making all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.operators import kernels as K
from quoin.operators import matching as M
from quoin.operators import spatial as P
from quoin.plans import policies as catalogue

SF = "/root/testdata/sf0.001"
INF, NAN = math.inf, math.nan
POINT = "k int, m double, v double"


def shown(df):
    return sorted((r.k, r.n, *(None if x is None else "nan" if math.isnan(x) else round(x, 9) for x in (r.median, r.p90)), r.passed) for r in df.collect())


def test_pair_agreement_like_a_join(spark):
    rng = np.random.default_rng(3)
    near = [[(int(k), float(m), float(v)) for k, m, v in zip(rng.integers(0, 6, 300), rng.integers(0, 9, 300), rng.normal(0, 4, 300))] for _ in "ab"]
    odd = [[(10, 0.0, v) for v in (INF, 1.0, 2.0, None)] + [(11, 0.0, NAN)] * 3 + [(12, 0.0, None), (13, 1.0, 0.0), (14, None, 0.0), (15, 0.0, 5.0)] * 3, [(10, 0.0, v) for v in (INF, -INF, 1.0)] + [(11, 0.0, 1.0)] * 3 + [(12, 0.0, 1.0), (13, 2.0, 0.0), (14, None, 0.0), (15, 0.0, 5.0)] * 3]
    a, b = (spark.createDataFrame(x + y, POINT) for x, y in zip(near, odd))
    pairs = a.alias("a").join(b.alias("b"), F.expr("a.k = b.k AND a.m = b.m")).select("a.k", (F.abs(F.col("a.v") - F.col("b.v")) / 10).alias("error"))
    got = shown(M.pair_agreement(a, b, "k", "m", "v", 10.0))
    assert got == shown(M.agreement(pairs, "k")) and {r[0] for r in got} == {*range(6), 10, 11, 12, 15}


def test_pair_agreement_of_400_million_pairs(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.lit(0.0).alias("m"), F.col("id").cast("double").alias("v"))
    r = M.pair_agreement(df, df, "k", "m", "v").first()
    d = np.arange(n)
    upto = np.cumsum(np.where(d == 0, n, 2 * (n - d)))
    at = lambda q: np.interp((n * n - 1) * q % 1, [0, 1], [float(np.searchsorted(upto, int((n * n - 1) * q) + i, "right")) for i in (0, 1)])
    assert (r.n, r.median, r.p90, r.passed) == (n * n, at(0.5), at(0.9), False)


@pytest.mark.parametrize("at_once, tried", [(5, 3), (1 << 21, 100_000)])
def test_every_rank_of_the_gaps(monkeypatch, at_once, tried):
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(K, "PAIRS_TRIED", tried)
    rng = np.random.default_rng(4)
    for values in (lambda n: rng.normal(size=n), lambda n: rng.integers(0, 3, n) * 1.0, np.zeros, lambda n: rng.choice([1e308, -1e308, 5e-324], n)):
        (c, a), (e, b) = ((rng.integers(0, 3, n), values(n)) for n in (15, 20))
        with np.errstate(over="ignore"):
            d = sorted(abs(x - y) / 10 for x, p in zip(a, c) for y, q in zip(b, e) if p == q)
        g = K.Gaps(c, a, e, b, 10.0)
        assert [g.nth(k) for k in range(g.n)] == list(zip(d, [*d[1:], d[-1]], strict=True))


def test_cross_view_agreement_makes_no_pairs(spark):
    assert "Join" not in catalogue.QUERIES["cross_view_agreement"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def neighbours(a, b, radius, k):
    """By a plain loop: ranks for each a_id over all its rows."""
    pairs = [(i, math.sqrt((u - x) * (u - x) + (v - y) * (v - y)), j) for i, x, y in a for j, u, v in b if None not in (x, y, u, v)]
    near = sorted(p for p in pairs if p[1] <= radius)
    return sorted((i, r + 1, j, d) for i in {p[0] for p in near} for r, (_, d, j) in enumerate([p for p in near if p[0] == i][:k]))


def test_nearest_like_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    spots = lambda n, size, base: [(base + i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, size, (n, 2)))]
    grid = lambda n, size, base: [(base + i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-size, size, (n, 2)))]
    odd = [(0, None, 1.0), (1, NAN, 1.0), (2, INF, 0.0), (3, -INF, INF), (4, 1e300, 0.0), (5, 1e300, 0.0), (6, -0.0, 0.0), (7, 30.0, 0.0), (8, 60.0, 0.0), (9, -30.0, 0.0), (9, 0.0, 30.0)]
    a = odd + spots(60, 0.05, 100) + spots(40, 200, 200) + grid(40, 20, 300) + [(400, 5.0, 5.0)] * 2 + [(401, -0.01, 700.0)]
    b = odd + spots(300, 0.05, 1000) + spots(150, 200, 2000) + grid(200, 20, 3000) + [(4000 + i, 5.0, 5.0) for i in range(9)] + [(5000 + i, i / 1000, 700.0) for i in range(50)]
    frames = [spark.createDataFrame(x, "id int, x double, y double") for x in (a, b)]
    got = sorted((r.a_id, r.rank, r.b_id, r.distance) for r in P.nearest(*frames, 30.0).collect())
    assert got == neighbours(a, b, 30.0, 5)


def test_nearest_where_all_are_near(spark):
    """4 thousand million pairs are within the radius."""
    a = spark.range(20_000).select("id", (F.col("id") % 200 / 10).alias("x"), (F.floor(F.col("id") / 200) / 10).alias("y"))
    b = spark.range(200_000).select("id", (F.col("id") % 200 / 10).alias("x"), (F.floor(F.col("id") / 200) % 100 / 10).alias("y"))
    got = P.nearest(a, b, 30.0).groupBy("rank").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.bool_and(F.col("b_id") == F.col("a_id") + 20_000 * (F.col("rank") - 1)).alias("same"))
    assert sorted(map(tuple, got.collect())) == [(r, 20_000, 0.0, True) for r in range(1, 6)]
