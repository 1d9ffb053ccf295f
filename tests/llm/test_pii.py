"""Personal data: patterns against plain searches, the field against all segmentations, planted cases."""

import hashlib
import math
import random
import re
import time

import numpy as np
import plain as P0
import pyarrow.parquet as pq
import pytest

from quoin.llm import op13_pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id long, text string, base string, added string, kind string, start int"


def check_digit(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v // 10 + v % 10
    return s % 10 == 0


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if max(map(int, m.group().split("."))) <= 255]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and check_digit(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("seed", range(5))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "+1 (212) 555-0123", "+", "a@b.c", "x.y+z@d-e.f.g", "@", "@b.c", ".", "-", " ", "  ", "(", ")", "7", "12", "é", "世", "a", "\n", "+49", "30 1234567", "5500-0000-0000-0004"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert P.base_spans(t) == plain(t), t


def test_base_spans_of_the_documents():
    for t in pq.read_table(f"{P0.SF}/documents.parquet")["text"].to_pylist():
        assert P.base_spans(t or "") == plain(t or "")


def segmentations(r, i=0):
    """Every way to cut the tokens from i on: lists of candidates."""
    if i == r.n:
        yield []
        return
    for rest in segmentations(r, i + 1):
        yield rest
    for cs in r.candidates:
        for c in cs:
            if c.lo == i:
                for rest in segmentations(r, c.hi):
                    yield [c, *rest]


@pytest.mark.parametrize("text", ["+1 (377) 555-0271 4111111111111111", "7536784127813050 4845168114407329", "1.2.3.4.5 192[.]168[.]1[.]20", "+49 30 1234567 10.0.0.1", "joe at example dot com"])
def test_field_against_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    for mask in (bytearray(len(text)), P.mask_of(text, P.base_spans(text))):
        r = P.Region(text, 0, len(text), mask)
        for _ in range(4):
            w = rng.normal(size=len(P._names))
            score = lambda s, w=w: sum(w[f] for c in s for f in c.features)
            every = list(segmentations(r))
            assert score(r.best(w)) == pytest.approx(max(map(score, every)))
            total = sum(math.exp(score(s)) for s in every)
            for c, p in r.expected(w):
                assert p == pytest.approx(sum(math.exp(score(s)) for s in every if any(x is c for x in s)) / total)


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(3)
    windows = []
    for _ in range(40):
        d = "".join(rng.choice("0123456789") for _ in range(15))
        for t in (f"at {'.'.join(str(rng.randrange(256)) for _ in range(4))} on", f"by +{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} of", f"is w{rng.randrange(9)}.{rng.randrange(99)}@mail.example.com so", f"pay {d}{next(c for c in '0123456789' if check_digit(d + c))} in"):
            windows += P.windows_of(t)
    return P.train(windows)


PLANTED = [
    ("x +1 (826) 555-4081 190.137.223.204 y", [(1, 20, 35), (3, 2, 19)]),
    ("+1 (377) 555-0271 4111111111111111", [(2, 18, 34), (3, 0, 17)]),
    ("a 4111111111111111 5500000000000004 b", [(2, 2, 18), (2, 19, 35)]),
    ("2353820953013749 4111111111111111", [(2, 17, 33)]),
    ("joe.doe [at] mail7 [dot] example [dot] com", [(0, 0, 42)]),
    ("ip 192[.]168[.]1[.]20 here", [(1, 3, 21)]),
]


def test_planted_spans_are_found_and_clean_texts_left_alone(weights):
    for text, want in PLANTED:
        base = P.base_spans(text)
        assert sorted(base + P.added(text, base, weights)) == want, text
    clean = ["3.14159 2.71828 1.41421", "9807915762804490", "2023-11-12 10:20:30", "978-3-16-148410-0", "a dot on the map", "look at example. dot it", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "1 000 000 000 000", "12345678 87654321"]
    assert [t for t in clean if P.added(t, P.base_spans(t), weights)] == []
    for t in pq.read_table(f"{P0.SF}/documents.parquet")["text"].to_pylist():
        if t and not re.search("[0-9@]", t):
            assert not P.added(t, [], weights)


def test_held_out_numbers_in_chains(weights):
    """Pairs of right and spoilt cards and phones in one chain, none of them seen in training."""
    rng = random.Random(99)
    right = wrong = total = 0
    for _ in range(300):
        text, want = "", []
        for _ in range(2):
            d = "".join(rng.choice("0123456789") for _ in range(15))
            last = next(c for c in "0123456789" if check_digit(d + c))
            kind = rng.randrange(3)
            s = d + last if kind == 0 else d + str((int(last) + 5) % 10) if kind == 1 else f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
            text += " " * bool(text)
            if kind != 1:
                want.append((2 if kind == 0 else 3, len(text), len(text) + len(s)))
            text += s
        base = P.base_spans(text)
        got = set(base + P.added(text, base, weights))
        right, wrong, total = right + len(got & set(want)), wrong + len(got - set(want)), total + len(want)
    assert right >= 0.97 * total and wrong <= 0.02 * total


@pytest.mark.parametrize("text", ["1" * 300_000, "1 " * 150_000, "1.2.3.4 " * 40_000, "+1 " * 100_000, "a" * 300_000 + "@", "@" * 300_000, "a@b.c " * 50_000, "+" + " 1(" * 100_000, "dot at " * 3000, "4111111111111111 " * 5000])
def test_long_texts_take_linear_time(text, weights):
    began = time.time()
    base = P.base_spans(text)
    P.added(text, base, weights)
    assert time.time() - began < 30


def test_rows(spark):
    t = [None, "", "no data", "é世 jo@example.com", "jo@example.com 10.0.0.1 4111111111111111 +1 (212) 555-0123", "x " * 20_000 + "10.0.0.1", *[t for t, _ in PLANTED]]
    rows = [(i, x, "b", "a", "k", 1) for i, x in enumerate(t)] + [(None, t[4], "b", "a", "k", 1), (4, t[4], "b", "a", "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(P.digest(P.find(df, P.fit(df))).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4, 4, *range(5, len(t)), None]
    for r in got:
        text = t[4 if r.doc_id is None else r.doc_id] or ""
        base = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        told = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(told) <= set(every) and len(every) == len(told) + r.n_added
        order = [(P.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert order == sorted(order)
    assert P.digest(P.find(df.limit(0), P.fit(df.limit(0)))).collect() == []
