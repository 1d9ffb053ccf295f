"""Operators on documents against plain versions: nulls, empty and long texts, ties, repeated rows, clashing names."""

import plain
import pytest
from pyspark.sql import functions as F

from quoin.llm import op1_substring, op2_suffix, op4_language, op5_jaccard, op6_toxicity, op7_mixing, op10_sentencepiece


def keyed(rows):
    return {i: r[1] or "" for i, r in enumerate(rows)}


@pytest.mark.parametrize("batches", [1, 3])
def test_op1_like_plain(docs, rows, batches):
    want = plain.windows_removed(keyed(rows), lambda t: t.encode().split(), 35)
    expected = sorted((r[0], len(u), sum(g), plain.sha(b" ".join(w for w, x in zip(u, g) if not x))) for r, (u, g) in zip(rows, want.values()))
    got = op1_substring.remove_repeats(docs, with_text=True, batches=batches)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == expected
    assert all((r.kept is None) == (r.n_removed == 0) for r in got.collect())


def test_op1_words_are_split_at_ascii_spaces_only():
    assert "a\u00a0b\x1cc d".encode().split() == [w.encode() for w in plain.WORD.findall("a\u00a0b\x1cc d")]


def test_op1_index_is_incremental(spark, docs):
    index = op1_substring.FingerprintIndex(spark, fanout=2)
    for i in range(5):
        index.ingest(docs.where(F.col("doc_id") % 5 == i))
    assert sum(map(len, index.levels)) <= 3 and not index.levels[0][1:]
    same = op1_substring.indexed(docs, batches=1)
    a, b = (sorted(map(tuple, x.repeats(docs).select("h1", "n_removed", "kept_sha256").collect())) for x in (index, same))
    assert a == b


@pytest.mark.parametrize("hot", [4096, 0, 2])
def test_op2_like_plain(docs, rows, hot):
    want = plain.windows_removed(keyed(rows), lambda t: t.encode(), 200)
    expected = []
    for r, (u, g) in zip(rows, want.values()):
        spans = sum(1 for x, y in zip([False, *g], g) if y and not x)
        expected.append((r[0], len(u), sum(g), spans, plain.sha(bytes(c for c, x in zip(u, g) if not x))))
    got = op2_suffix.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_op2_corpus_order_is_lexicographic():
    import random

    rng = random.Random(2)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 300))) for _ in range(20)]
    strings += [strings[0], strings[1][5:] + b"abc"]
    starts, same = op2_suffix.corpus_order(strings, 12)
    whole, ends = b"".join(strings), []
    for s in strings:
        ends.append((ends[-1] if ends else 0) + len(s))
    suffix = [whole[i : next(e for e in ends if e > i)] for i in starts.tolist()]
    assert [s[:12] for s in suffix] == sorted(s[:12] for s in suffix)
    assert same.tolist() == [False] + [a[:12] == b[:12] for a, b in zip(suffix, suffix[1:])]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_op5_like_plain(docs, rows, k, percent):
    texts = {r[0]: r[1] for r in rows}
    sets, root = plain.jaccard_roots(texts, k, percent)
    got = op5_jaccard.joined(docs, op5_jaccard.Join(k, percent)).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], len(sets[r[0]]), root[r[0]]) for r in rows)


def test_op5_small_tiles(docs, rows, monkeypatch):
    monkeypatch.setattr(op5_jaccard, "TILE", 300)
    _, root = plain.jaccard_roots({r[0]: r[1] for r in rows}, 4, 85)
    assert {r.doc_id: r.component_id for r in op5_jaccard.joined(docs).collect()} == root


def test_op5_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, "A B C D E"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, op5_jaccard.joined(df).collect()), key=str) == sorted([(None, 2, None), (3, 2, 2), (2, 2, 2), (None, 0, None)], key=str)


def test_op4_held_out_accuracy(spark):
    got = op4_language.query(spark, plain.SF.replace("0.001", "0.01"))
    lang = spark.read.parquet(f"{plain.SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    right, n = got.where("held_out").join(lang, "doc_id").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.98
    assert got.where("score < 0 OR score > 1 OR coverage < 0 OR coverage > 1").count() == 0


def test_op4_edges(spark, docs, rows, empty):
    got = {(r.doc_id): r for r in op4_language.identify(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert all((got[r[0]].lang_pred == "und") == (not any(c.isalpha() for c in r[1] or "")) for r in rows)
    assert op4_language.identify(empty).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in op4_language.identify(nothing).collect()} == {"und"}


def test_op4_filter_has_no_false_negatives():
    import numpy as np

    a, b = np.arange(1000, 6000, dtype=np.uint32), np.arange(5000, 9000, dtype=np.uint32)
    m = op4_language.Model.build({"x": a, "y": b})
    mask = np.bitwise_and.reduce([m.table[0][i] for i in op4_language.probes(np.r_[a, b], m.table.shape[1])])
    assert (mask[: len(a)] & 1).all() and (mask[len(a) :] & 2).all() and (m.rate < 0.05).all()


def test_op4_counts_like_plain(spark, monkeypatch):
    """Model and counts against plain loops, with slices so short that most texts are cut."""
    from collections import Counter

    monkeypatch.setattr(op4_language, "SLICE", 64)
    monkeypatch.setattr(op4_language.pieces, "__defaults__", (64,))

    def plainly(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7") else c for c in t)
        raw = b"   " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low.encode()) + b"   "
        return Counter(raw[i : i + 4] for i in range(len(raw) - 3) if raw[i : i + 4].strip())

    texts = {"en": ["the quick brown fox, THE end " * 7, "a"], "de": ["Über das Öl und die \u00c4pfel 12 " * 9, ""], "xx": ["\u4e16\u754c" * 40]}
    rows = [(t, k) for k, ts in texts.items() for t in ts]
    m = op4_language.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", least_share=0.01)
    assert m.languages == ("de", "en", "xx")
    found = {}
    for k, ts in texts.items():
        n = sum(map(plainly, ts), Counter())
        found[k] = {g for g, x in n.items() if x >= 0.01 * sum(n.values())}
    asked = ["THE fox und das", "\u4e16\u754c the " * 30, "Öl"]
    hits, n = m.counts([t.encode() for t in asked])
    for i, t in enumerate(asked):
        g = plainly(t)
        assert n[i] == sum(g.values())
        for j, k in enumerate(m.languages):
            raw = hits[i, j] * (1 - m.rate[j]) + n[i] * m.rate[j]
            assert abs(raw - sum(x for y, x in g.items() if y in found[k])) <= max(2, 0.02 * n[i])


def test_op4_any_column_name(spark):
    df = spark.createDataFrame([(1, "hello there", "en", 7, "v"), (2, "guten tag", "de", 8, None)], "doc_id long, text string, lang string, t long, `a.b` string")
    got = {r.doc_id: r for r in op4_language.identify(df, keep=("doc_id", "t", "a.b")).collect()}
    assert got[1].t == 7 and got[1]["a.b"] == "v" and got[2].t == 8


def test_op6_held_out(spark):
    sf = plain.SF.replace("0.001", "0.01")
    got = op6_toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count("*")).first()
    assert right / n > 0.9


def test_op6_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else int(i % 3 == 0)) for i in range(0, 40)] + [(3, 0)], "doc_id long, toxic int")
    got = op6_toxicity.predict(docs, op6_toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in op6_toxicity.predict(docs, op6_toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert op6_toxicity.predict(empty, op6_toxicity.fit(empty, labels)).count() == 0


def test_op6_isotonic_is_monotone():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    xs, ys = op6_toxicity.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(xs) > 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] < 0.2 and 0.8 < ys[-1] < 1


def test_op7_marginals_meet_targets(spark):
    cells = spark.createDataFrame([(a, b, c, float(t)) for a, b, c, t in [("x", "p", "u", 100), ("x", "q", "v", 50), ("y", "p", "v", 10), ("y", "q", "u", 40), ("z", "p", "u", 5), ("z", "q", "v", 7)]], "source string, lang string, topic string, t double")
    dims = {"source": 0.5, "lang": 0.7}
    got = op7_mixing.rake(cells, dims, 30)
    for d, power in dims.items():
        r = {x[0]: (x.w, x.t) for x in got.groupBy(d).agg(F.sum("w").alias("w"), F.sum("t").alias("t")).collect()}
        total = sum(t**power for _, t in r.values())
        assert all(abs(w - t**power / total) < 1e-6 for w, t in r.values())


def test_op7_edges(docs, rows, empty):
    got = op7_mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {r.doc_id: r.tokens for r in got} == {r[0]: len(plain.WORD.findall(r[1] or "")) for r in rows}
    assert op7_mixing.mix(empty).count() == 0
    expected = sum(r.probability * r.tokens for r in got) / sum(r.tokens for r in got)
    assert abs(expected - op7_mixing.BUDGET) < 0.02


def test_op10_like_library(docs, rows):
    library, agenda, *_ = op10_sentencepiece.loaded(op10_sentencepiece.default_model())
    got = op10_sentencepiece.encode_documents(docs, op10_sentencepiece.default_model(), with_ids=True).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows) and all(r.agreed for r in got)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == plain.sha(" ".join(map(str, ids)).encode()) and r.decoded_sha256 == plain.sha(library.decode(ids).encode())


def test_op10_words_in_step():
    import random

    library, *_ = op10_sentencepiece.loaded(op10_sentencepiece.default_model())
    rng = random.Random(5)
    letters = ["a", "e", "t", "th", "ing", "er", "é", "ß", "&", ".", "\n", "\0", "漢", "🙂", "'", "0", "aaaa"]
    words = {"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(6000)} | {"x" * n for n in range(1, 130)}
    texts = [" ".join(rng.choices(sorted(words), k=700)) for _ in range(12)] + ["", " a", "a  b", "▁a b"]
    expected = library.encode(texts, add_eos=True)
    for cache in (op10_sentencepiece.CACHE, 1000, 10):
        agenda = op10_sentencepiece.Agenda.of(library, cache)
        assert agenda.encode_all(texts) == expected
        assert agenda.encode_all(texts[::-1]) == expected[::-1]
        assert len(agenda.kept) + len(agenda.older) <= cache
    short = sorted(w for w in words if len(w) < op10_sentencepiece.SHORT)
    in_step = dict(agenda.merged_in_step(short))
    assert set(in_step) >= {w for w in short if all(c in agenda.pieces for c in w)}  # others are solved one by one
    assert all(tuple(ids) == agenda.merge(op10_sentencepiece.SPACE + w) for w, ids in in_step.items())


def test_op10_agenda_on_odd_texts():
    import random

    library, agenda, *_ = op10_sentencepiece.loaded(op10_sentencepiece.default_model())
    rng = random.Random(1)
    alphabet = [*" \t\n ab▁éÅ中🎉<s>0xthein.'\x00", "  ", "   ", "the ", "x" * 50]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert agenda.encode(t) == library.encode(t, add_eos=True), repr(t)


def test_empty_tables(empty):
    assert op1_substring.remove_repeats(empty).count() == 0
    assert op2_suffix.remove_repeats(empty).count() == 0
    assert op5_jaccard.joined(empty).count() == 0
    assert op10_sentencepiece.encode_documents(empty, op10_sentencepiece.default_model()).count() == 0


def mirrored(n):
    """A word over two letters and its mirror, on which rolling sums modulo a power of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 65, 2048])
def test_long_words_are_told_apart(spark, n):
    one, two = mirrored(n)
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in op1_substring.remove_repeats(df).collect()] == [0, 0]
    words = spark.createDataFrame([(1, one), (2, two), (3, two.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op5_jaccard.joined(words).collect()} == {1: 1, 2: 2, 3: 2}


def test_texts_longer_than_a_slice(spark):
    """Texts over SLICE words and bytes, whose repeats lie in different slices and texts."""
    import random

    rng = random.Random(8)
    long = [f"{rng.getrandbits(24):x}" for _ in range(300_000)]
    passage = [f"passage{i}" for i in range(50)]
    texts = [" ".join([*long[:270_000], "A", *passage, "B", *long[270_000:]]), " ".join(["C", *passage, "D"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in op1_substring.remove_repeats(df).collect()} == {0: 50, 1: 50}
    shared = len(" ".join(passage)) + 2  # with the blanks beside it
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op2_suffix.remove_repeats(df).collect()} == {i: (len(t), shared, 1) for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.n_shingles for r in op5_jaccard.joined(df).collect()}
    assert sizes == {i: len(s) for i, s in plain.shingle_sets(dict(enumerate(texts)), 4).items()}


def test_op6_long_texts_take_linear_time():
    import time

    x = op6_toxicity.Extractor(op6_toxicity.lexicon_of(["badword", "badw~"]))
    assert x("such a b4dw0rd")[4] == 1 and x("x" * 60 + "b4dword")[4] == 0
    for t in ("a" * 1_000_000, "世" * 300_000, "a1" * 500_000, "b4dword " * 100_000, "." * 1_000_000):
        begun = time.time()
        assert len(x(t)) == len(op6_toxicity.FEATURES)
        assert time.time() - begun < 5


def test_op6_repeated_labelled_ids(spark):
    docs = spark.createDataFrame([(i % 50, f"word{i} text", 1) for i in range(400)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, toxic int")
    assert op6_toxicity.predict(docs, op6_toxicity.fit(docs, labels, sample=20)).count() == 400


def test_op10_agrees_with_the_library_on_a_whole_table(spark):
    got = op10_sentencepiece.query(spark, plain.SF.replace("0.001", "0.01"))
    assert got.where("NOT agreed").count() == 0


def test_op10_equal_texts_have_equal_rows_with_and_without_ids(spark):
    texts = ["a b c", None, "", "a b c", "中文" * 2000, "中文" * 2000, "a  b", "a b c"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = op10_sentencepiece.default_model()
    plain_rows = {r.doc_id: r for r in op10_sentencepiece.encode_documents(docs, model).collect()}
    with_ids = op10_sentencepiece.encode_documents(docs, model, with_ids=True).collect()
    library = op10_sentencepiece.loaded(model)[0]
    assert len(with_ids) == len(plain_rows) == len(texts)
    for r in with_ids:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.agreed and r.n_tokens == len(r.ids)
        assert (r.ids_sha256, r.decoded_sha256) == (plain_rows[r.doc_id].ids_sha256, plain_rows[r.doc_id].decoded_sha256)
