"""Ranked lexical search against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quoin.llm import op12_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, n long, term string, score double"
ITEMS = "item_id long, text string, row long, rank int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def case(kind):
    rng = random.Random(kind)
    word = lambda: rng.choice(["Über", "naïve", "x1", "世界"]) if rng.random() < 0.1 else f"w{min(rng.randrange(200), rng.randrange(200))}"
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-", "_", "\x7f", " \t"]) for _ in range(n))
    if kind == "mixed":
        docs = [(i, text(rng.randrange(1, 60))) for i in range(300)] + [(301, None), (302, ""), (303, " .,;- "), (None, text(30)), (304, text(5000)), (305, "z" * 70_000)]
        docs += docs[:3] + [(5, text(20))] + [(1000 + i, docs[7][1]) for i in range(30)]  # copies tie
        items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(30, None), (31, "..."), (32, "nowhere"), (None, text(5)), (33, docs[7][1]), (33, docs[8][1]), (34, "W3 w3 w3 w150")]
        return docs, items
    if kind == "copies":
        return [(i, "the same words stand here") for i in range(500)] + [(600, "other")], [(1, "same words"), (2, "other words here")]
    if kind == "one":
        return [(7, "a")], [(1, "a b"), (2, "A")]
    return ([], [(1, "a")]) if kind == "no documents" else ([(1, "a")], [])


@pytest.mark.parametrize("kind", ["mixed", "copies", "one", "no documents", "no items"])
@pytest.mark.parametrize("filtered", [True, False])
def test_same_rows_as_plain_loops(spark, monkeypatch, kind, filtered):
    docs, items = case(kind)
    df = spark.createDataFrame([(i, t, "en", 1, "t", 1.0) for i, t in docs], DOCS).repartition(3)
    asked = R.item_terms(spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS), "item_id", "text")
    slices = R.stored(R.index(df, R.asked_terms(asked) if filtered else None), "slices")
    assert sorted(map(tuple, R.search(slices, asked).collect()), key=repr) == plain(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_the_best_of_a_slice(seed, monkeypatch):
    """Slices and fronts of a few rows, items in several parts."""
    import pyarrow as pa

    rng = random.Random(seed)
    monkeypatch.setattr(R, "FRONT", 200)
    docs = [(rng.randrange(10**6), " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(1, 50)))) for _ in range(400)]
    s, parts = R.Slices(0, None), []
    for i, t in docs:
        s.add(i, t.encode())
        if len(s.ids) == 90:
            parts.append(s.packed())
    parts.append(s.packed())
    slices = pa.Table.from_batches(parts)
    n, length = len(docs), sum(len(terms(t)) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(terms(t)))
    items = [(q, " ".join(f"w{rng.randrange(1, 40)}" for _ in range(8))) for q in range(9)]
    known = [{w: c for w, c in Counter(terms(t)).items() if w in df} for _, t in items]
    asked = pa.table({"row": list(range(9)), "terms": [[w.encode() for w in c] for c in known], "weights": [[x * R.weight(n, df[w]) for w, x in c.items()] for c in known]})
    got = R.best_of(asked, slices, n, length, 10).to_pylist()
    want = plain(docs, items)
    assert sorted((r["row"], r["doc_id"], r["score"]) for r in got) == sorted((q, i, v) for q, _, i, v in want)


def test_treaps_are_in_both_orders():
    rng = np.random.default_rng(1)
    df = np.array([40, 1, 200])
    doc = np.concatenate([np.sort(rng.choice(300, n, replace=False)) for n in df])
    t = R.Treaps(rng.integers(1, 400, 300), df, doc, rng.integers(1, 5, len(doc)), 300, 60_000)

    def check(node, lo, hi):
        if node < 0:
            return 0
        assert lo < t.doc[node] < hi
        kids = [t.left[node], t.right[node]]
        assert all(t.impact[k] <= t.impact[node] for k in kids if k >= 0)
        return 1 + check(kids[0], lo, t.doc[node]) + check(kids[1], t.doc[node], hi)

    assert [check(t.grow(k), -1, 300) for k in range(3)] == df.tolist()


def test_walk_scores_few_documents():
    """One rare term: documents that hold only a frequent one are not scored once ten better ones are known."""
    rng = np.random.default_rng(2)
    n = 5000
    rare = np.sort(rng.choice(n, 30, replace=False))
    t = R.Treaps(rng.integers(20, 400, n), np.array([n, 30]), np.concatenate([np.arange(n), rare]), np.ones(n + 30, dtype=np.int64), n, 210 * n)
    best = R.Best(1, 10)
    scored = R.walk(t, np.array([[0, 1]]), np.array([[R.weight(n, n // 2), R.weight(n, 30)]]), np.arange(n), np.zeros(n, bool), best)
    assert set(best.id.tolist()) <= set(rare.tolist()) and len(best.id) == 10
    assert scored < n / 10
