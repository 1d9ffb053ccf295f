"""Results that rounding or chosen hash collisions must not change."""

import hashlib
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from quoin.llm import op1_substring, op2_suffix, op5_jaccard, op8_embeddings, op9_topk
from quoin.llm.shared import text_key

VECTORS = "vec_id long, embedding array<double>, label int, n_links long, k string"


def linked(rows):
    ids, x, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    norm = np.sqrt((x**2).sum(axis=1))
    near = ((x @ x.T) / (norm[:, None] * norm[None]) >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    root = plain.roots(zip(*[ids[k].tolist() for k in np.nonzero(near)], strict=True), ids.tolist())
    return {int(i): (int(n), root[int(i)]) for i, n in zip(ids, near.sum(axis=1), strict=True)}


def tight(noise, n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    return [(i, (base + noise * rng.normal(size=dim)).tolist(), 0, 1, "k") for i in range(n)]


@pytest.mark.parametrize("noise", [1e-8, 1e-9, 1e-15, 1e-3])
def test_op8_tight_groups(spark, noise):
    rows = tight(noise)
    got = op8_embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == linked(rows)


def test_op8_pairs_close_to_the_threshold():
    """Two groups of near copies whose cosines are 0.93 give or take 3e-11 lose no link and gain none."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        a, b = np.zeros(32), np.zeros(32)
        a[0], b[1] = 1.0, 1.0
        up = lambda c, a=a, b=b: c * a + np.sqrt(1 - c * c) * b
        x = np.array([a * (1 + 1e-9 * k) + 1e-12 * rng.normal(size=32) for k in range(90)] + [up(0.93 + 3e-11 * rng.choice([-1, 1])) * (1 + rng.random()) for _ in range(90)])
        ids, w = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        n_a, _, edges = op8_embeddings.links(ids, x, w, ids, x, w, True, 0.93)
        want = linked([(i, v, 0) for i, v in enumerate(x.tolist())])
        assert n_a.tolist() == [want[i][0] for i in range(len(x))]
        half = np.arange(90)
        left, right, _ = op8_embeddings.links(half, x[:90], w[:90], half, x[90:], w[90:], False, 0.93)
        norm = np.sqrt((x**2).sum(axis=1))
        near = (x[:90] @ x[90:].T) / (norm[:90, None] * norm[None, 90:]) >= 0.93
        assert left.tolist() == near.sum(axis=1).tolist() and right.tolist() == near.sum(axis=0).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_op9_large_scores(spark, seed):
    rng = random.Random(seed)
    shared = [rng.randrange(900_000, 1_000_000) for _ in range(8)]
    rows = [(i, [float(s + rng.randrange(3)) for s in shared] + [float(rng.randrange(-5, 6)) for _ in range(24)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for i, v in rows[::50]:
        best = sorted((-sum(int(256 * p) * int(256 * q) for p, q in zip(v, x)), j) for j, x in rows if j != i)[:5]
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert sorted(map(tuple, op9_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == want


def test_text_keys_are_of_a_digest(spark):
    texts = [None, "", "a", "é世", "x" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *text_key(F.col("t"))).collect()
    for i, a, b in got:
        d = hashlib.sha256((texts[i] or "").encode()).digest()
        want = tuple(int.from_bytes(d[8 * k : 8 * k + 8], "big", signed=True) for k in (0, 1))
        assert (a, b) == ((0, 0) if texts[i] is None else want)


ALIKE = ("qocawtvnviludhdl", "lwhwlaun1o,/wk8z")
"""Words that one of the two word hashes does not tell apart."""


def test_op5_words_that_share_a_hash(spark):
    rows = [(1, " ".join([ALIKE[0]] * 4)), (2, " ".join([ALIKE[1]] * 4)), (3, " ".join([ALIKE[0]] * 4)), (4, ALIKE[0]), (5, ALIKE[1])]
    rows += [(10 + i, " ".join([*ALIKE[i % 2 : i % 2 + 1] * 4, *(f"w{k}" for k in range(3 + i))])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard.joined(docs).collect()}
    sets, root = plain.jaccard_roots(dict(rows), 4, 85)
    assert got == {i: (len(sets[i]), root[i]) for i, _ in rows}


def test_pipeline_keeps_texts_that_share_a_hash_and_rows_with_maps(spark):
    import corpus_pipeline

    rows = [(1, " ".join([ALIKE[0]] * 5), {"a": 1}), (2, " ".join([ALIKE[1]] * 5), {"b": 2}), (3, " ".join([ALIKE[0]] * 5), None), (3, " ".join([ALIKE[0]] * 5), {"c": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.extra) for r in got) == [(1, {"a": 1}), (2, {"b": 2})]


def test_words_that_share_a_hash_are_not_removed(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(99)}" for _ in range(60)]
    rows = [(i, " ".join(words[:30] + [ALIKE[i]] + words[30:])) for i in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.windows_removed(dict(rows), plain.WORD.findall, 35)
    for r in op1_substring.remove_repeats(docs).collect():
        assert r.n_removed == sum(want[r.doc_id][1])
    want = plain.windows_removed({i: t.encode() for i, t in rows}, list, 200)
    for r in op2_suffix.remove_repeats(docs).collect():
        assert r.n_removed == sum(want[r.doc_id][1])
