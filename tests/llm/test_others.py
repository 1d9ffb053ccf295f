"""URL filters, vectors, components and the pipeline."""

import random

import numpy as np
import plain
import pytest

from quoin.llm import op3_urls, op8_embeddings, op9_topk
from quoin.llm.components import components


def by_hand(url):
    u = url or ""
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = "".join(c for c in rest)
    for i, c in enumerate(rest):
        if c in "/?#":
            host = rest[:i]
            break
    path = rest[len(host) :]
    for i, c in enumerate(path):
        if c in "?#":
            path = path[:i]
            break
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_by_hand(host, path):
    best = None
    for r in op3_urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return (best.name, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=1#y", "https://example.com/de/", "http://example.com/de", "ftp://org/fr/x", "http://notorg/fr/", "http://a.net", "http://a.net/?q", "http://x#y", "a://b://c.net/en/", "http://É.Net/a.b%20/c?d=1&e=2", "http://m.example.org/fr/1.html"]


@pytest.mark.parametrize("urls", [URLS * 3, [None], ["http://a.net/x"], []])
def test_op3_rules(spark, urls):
    pages = spark.createDataFrame([(i, u, "html", "h", "r", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string, margin double")
    got = {r.page_id: r for r in op3_urls.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = by_hand(u)
        rule, verdict = rule_by_hand(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_op3_trees_learn_from_labels(spark):
    pages = spark.read.parquet(f"{plain.SF.replace('0.001', '0.1')}/pages.parquet")
    got = op3_urls.judge(pages).collect()
    ruled = [r for r in got if r.rule]
    verdict = {r.name: r.verdict for r in op3_urls.RULES}
    from pyspark.sql import functions as F

    held_out = {r.page_id for r in pages.where(~op3_urls.learnable(F.col("url"))).select("page_id").collect()}
    right = [(r.margin >= 0) == (verdict[r.rule] == "allow") for r in ruled if r.page_id in held_out]
    assert len(right) > 20 and sum(right) / len(right) > 0.9


def test_op3_suffix_statistics(spark):
    urls = spark.createDataFrame([("net",)] * 6 + [("com",)] * 3 + [("",)], "suffix string")
    known = spark.createDataFrame([("com", 1.0), ("com", 0.0), ("com", 1.0), ("de", 0.0)], "suffix string, y double")
    got = {r.suffix: tuple(r)[1:] for r in op3_urls.part_table(urls, known, "suffix").collect()}
    assert got == {"net": (0.6, 0.0, 0.5), "com": (0.3, 3.0, 2.5 / 4), "": (0.1, 0.0, 0.5), "de": (0.0, 1.0, 0.25)}


def test_op3_long_urls_and_any_name(spark):
    long = "http://a.net/" + "x/é?" * 100_000
    pages = spark.createDataFrame([(1, long, "s"), (2, "http://" + "h" * 300_000 + ".org/fr/1", None)], "`page.id` long, url string, suffix string")
    got = {r[0]: r for r in op3_urls.judge(pages, keep=("page.id", "suffix")).collect()}
    assert (got[1].host, got[1].rule, got[1].verdict) == ("a.net", "net/", "block") and got[1].path == by_hand(long)[1]
    assert got[2].rule == "org/fr/" and len(got[2].host) == 300_004


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.normal(size=8)
        rows += [(10 * i + j, [float(x) for x in v + rng.normal(size=8) * s], i % 3) for j, s in enumerate((0, 0.1, 0.25))]
    rows += [(5000, rows[0][1], 0), (5001, rows[0][1], 1), (5002, rows[3][1], None), (5003, None, 0), (5004, [], 0), (5005, [0.0] * 8, 0), (5006, [float("nan")] * 8, 0), (5007, [1.0, None, *[0.0] * 6], 0), (5008, [float("inf")] * 8, 1), (5009, [1.0, 2.0], 0), (5010, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 20])
def test_op8_like_plain(spark, block):
    rows, df = vectors(spark)
    pairs, n = [], dict.fromkeys((r[0] for r in rows), 0)
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[:i]:
            if k is not None and k == m and good(x) and good(y) and len(x) == len(y) and any(x) and any(y):
                p, q = np.array(x), np.array(y)
                if p @ q / np.sqrt(p @ p) / np.sqrt(q @ q) >= 0.93:
                    pairs.append((a, b))
                    n[a] += 1
                    n[b] += 1
    root = plain.roots(pairs, n)
    got = op8_embeddings.near_duplicates(df, block_rows=block).collect()
    assert sorted(map(tuple, got)) == sorted((k, n[k], root[k], root[k] == k) for k in n)


def test_op8_empty_and_repeated(spark):
    _, df = vectors(spark)
    assert op8_embeddings.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, op8_embeddings.near_duplicates(twice).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_op9_like_plain(spark, monkeypatch):
    monkeypatch.setattr(op9_topk, "SLICE_ROWS", 100)
    monkeypatch.setattr(op9_topk, "QUERY_GROUP", 3)
    rows, df = vectors(spark)
    ok = {a: [int(np.floor(256 * x)) for x in v] for a, v, _ in rows if good(v)}
    want = []
    for q in (a for a in ok if a % 50 == 0):
        s = sorted((-sum(x * y for x, y in zip(ok[q], v)), a) for a, v in ok.items() if a != q)[:5]
        want += [(q, i + 1, a, -v) for i, (v, a) in enumerate(s)]
    from pyspark.sql import functions as F

    got = op9_topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert op9_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    few = df.where("vec_id IN (0, 1, 2)")
    assert op9_topk.top_k(few, F.col("vec_id") % 50 == 0, 5).count() == 2


def test_op9_large_numbers_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1e6, 1e6 + 0.004]), (1, [1e6, 1e6]), (2, [1e6, 1e6 + 0.004])], "vec_id long, embedding array<double>")
    f = lambda x: int(np.floor(256 * x))
    a, b = (f(1e6), f(1e6 + 0.004)), (f(1e6), f(1e6))
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    assert [tuple(r) for r in op9_topk.top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 2, dot(a, a)), (0, 2, 1, dot(a, b))]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    want = plain.roots(edges, {x for e in edges for x in e})
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k: got.get(k, k) for k in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as c
    from quoin.llm import op7_mixing, op10_sentencepiece

    have = docs.drop("chunk").withColumnsRenamed({"h1": "t", "kept": "a.b"})
    out, kept = have, {r[0]: r[1] for r in rows}
    for name, stage in c.STAGES[:3]:
        out = stage(spark, out, "").cache()
        assert out.columns == have.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert name == "language_id" or out.count() == len(got)
        if name == "language_id":
            want = {k: t for k, t in kept.items() if any(x.isalpha() for x in t or "")}
            assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
        elif name == "near_duplicates":
            _, root = plain.jaccard_roots(kept, 5, 80)
            want = {k: t for k, t in kept.items() if root[k] == k}
            assert got == want
        else:
            want = {}
            for k, (u, g) in plain.windows_removed(kept, lambda t: t.encode().split(), 35).items():
                left = [w for w, x in zip(u, g) if not x]
                if left or not u:
                    want[k] = b" ".join(left).decode() if any(g) else kept[k]
            assert got == want
        kept = got
    mixed = c.mixture(spark, out, "")
    assert mixed.columns == have.columns
    plainly = plain.mixed([(r.doc_id, r.text, r.source, r.lang) for r in out.collect()], op7_mixing)
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted(plainly)
    library = op10_sentencepiece.loaded(op10_sentencepiece.default_model())[0]
    ids = {r.doc_id: list(r.ids) for r in c.tokens(spark, mixed, "").collect()}
    assert ids == {k: library.encode(t, add_eos=True) for k, t in plainly}
    for _, stage in c.STAGES:
        assert stage(spark, have.limit(0), "").count() == 0


def test_pipeline_loses_no_unlike_text(spark):
    import corpus_pipeline as c

    base = [(1, "one two three four five six seven", "x"), (1, "an other text that is not at all alike", "x"), (1, "one two three four five six seven", "y"), (2, "one two three four five six seven", "z")]
    odd = [(None, "one two three four five six seven", "n"), (3, None, "n"), (3, " ", "n"), (3, " ", "n")]
    df = spark.createDataFrame([(*r, None, 1) for r in base + odd], "doc_id long, text string, source string, lang string, n_chars long")
    got = [(r.doc_id, r.text) for r in c.near_duplicates(spark, df, "").collect()]
    want = [(1, base[0][1]), (1, base[1][1]), (None, base[0][1]), (3, None), (3, " "), (3, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_runs(spark):
    import corpus_pipeline as c

    n = spark.read.parquet(f"{plain.SF}/documents.parquet").count()
    assert 0 < c.run(spark, plain.SF).count() < n


def test_op8_very_small_and_large_numbers(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1e-200, 1.01e-200]), (3, [1e200, 1e200]), (4, [1e200, -1e200]), (5, [5e-324, 5e-324]), (6, [1e308, 1e-308])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_op8_clashing_names_and_ties(spark):
    a, b = [1.0, 0.0], [0.93, float(np.sqrt(1 - 0.93**2))]
    linked = int(a[0] * b[0] / np.sqrt(np.dot(b, b)) >= 0.93)
    df = spark.createDataFrame([(1, a, "x", 1, "c"), (2, b, "x", 2, "d")], "vec_id long, embedding array<double>, label string, id int, `a.b` string")
    got = op8_embeddings.near_duplicates(df.withColumnsRenamed({"id": "k"})).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, linked), (2, linked)]
