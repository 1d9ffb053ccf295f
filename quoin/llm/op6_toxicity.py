"""Operator 6: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learning: at most `sample` labelled rows that are not held out (the first in the order of a hash, one for each doc_id) are
taken and dealt to three parts. Words and four-letter beginnings that are far more frequent in toxic texts form a lexicon;
of each of the first two parts one is learnt for the features of the other, so no row is described by its own label, and
one of both for scoring. Dense features follow: lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates. Trees are grown on these two parts (logistic loss, histograms of quantile bins); the third part, which
neither lexicon nor trees have seen, calibrates their margin by isotonic regression. Scoring walks whole texts in Arrow
batches, in time linear in the text.

Null and empty texts have all features zero and get a score like any other; texts of any length and without blanks are
scored whole; an empty table gives an empty result; repeated rows get equal scores. Labels that are null are ignored; of
several labels of a document the highest counts, of several texts of a labelled doc_id the one with the least hash. Without
labels of both kinds the score is the share of toxic labels, or 0. Only doc_id, text and toxic are read, so other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op4_language import learnable
from .shared import stored

SAMPLE = 20_000
ODDS, GAIN = 2.5, 20.0
"""A word is of the lexicon from these log odds towards toxic texts and this likelihood ratio on."""
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
PREFIX = 4
NEAR = 6
#: Fixed words: second persons of the languages at hand.
SECOND_PERSON = frozenset("you your yours du dich dir dein deine ihr euch tu te ton ta tes toi vous votre tú ti usted ustedes vos vosotros".split())
#: Fixed characters: stand-ins for letters.
STAND_IN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", ".": "", "-": ""})
WORD = re.compile(r"[^\W\d_]+")
LETTER, MARK = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$*_]")
FEATURES = ("hits", "density", "prefix_hits", "prefix_density", "obfuscated_hits", "obfuscated_density", "near_second_person", "second_person", "capitals", "shouting", "exclaim", "punctuation", "digits", "length")


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    prefixes: frozenset[str]


def tokens_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:PREFIX] + "~" for w in words if len(w) > PREFIX}


class Extractor:
    """Features of texts; what a word hits is kept in a bounded cache."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.kept = lexicon, {}

    def kind(self, w: str) -> int:
        k = (1 if w in self.lexicon.words else 0) | (2 if w[:PREFIX] in self.lexicon.prefixes and len(w) > PREFIX else 0) | (4 if w in SECOND_PERSON else 0)
        if len(self.kept) > 300_000:
            self.kept.clear()
        self.kept[w] = k
        return k

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = WORD.findall(text.lower())
        n, c = max(1, len(words)), max(1, len(text))
        known, kind = self.kept, self.kind
        marks = [(i, k) for i, w in enumerate(words) if (k := known[w] if w in known else kind(w))]
        hit = [i for i, k in marks if k & 1]
        begun = [i for i, k in marks if k & 2 and not k & 1]
        you = [i for i, k in marks if k & 4]
        near = 0
        if you and (hit or begun):
            at = np.array(you)
            for i in hit + begun:
                j = int(np.searchsorted(at, i))
                near += any(abs(int(at[x]) - i) <= NEAR for x in (j - 1, j) if 0 <= x < len(at))
        masked = 0
        if MARK.search(text):
            for w in text.split():
                if len(w) < 3 or not MARK.search(w) or not LETTER.search(w):
                    continue
                s = w.strip(".,;:!?\"'()").lower().translate(STAND_IN)
                masked += s in self.lexicon.words or (len(s) > PREFIX and s[:PREFIX] in self.lexicon.prefixes)
        raw = text.encode()
        b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, lower = int(b[65:91].sum()), int(b[97:123].sum())
        shout = sum(1 for w in WORD.findall(text) if len(w) > 2 and w.isupper()) if upper > 0.2 * (lower + 1) else 0
        punct = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
        return [float(len(hit)), len(hit) / n, float(len(begun)), len(begun) / n, float(masked), masked / n, float(near), len(you) / n, upper / max(1, upper + lower), shout / n, int(b[33]) / c, punct / c, int(b[48:58].sum()) / c, float(np.log1p(n))]


def telling(a: Column, b: Column, n_toxic: int, n_clean: int) -> Column:
    """Whether a word of `a` toxic and `b` clean texts speaks for toxic ones: by odds and by the likelihood ratio."""
    if not n_toxic or not n_clean:
        return F.lit(False)
    base = n_toxic / (n_toxic + n_clean)
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    gain = 2 * (a * F.log(a / ((a + b) * base)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0))
    return F.coalesce((a > 0) & (odds > ODDS) & (gain > GAIN), F.lit(False))


def lexicon_of(words: list[str]) -> Lexicon:
    return Lexicon(frozenset(w for w in words if not w.endswith("~")), frozenset(w[:-1] for w in words if w.endswith("~")))


@dataclass(frozen=True)
class Booster:
    """Trees as arrays: feature (-1: leaf), threshold (left if <=), value by heap index; isotonic steps x to y."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def margin(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), self.start)
        rows = np.arange(len(f))
        for k in range(len(self.feature)):
            at = np.zeros(len(f), dtype=np.int64)
            for _ in range(DEPTH):
                j = self.feature[k][at]
                inner = j >= 0
                right = f[rows, np.maximum(j, 0)] > self.threshold[k][at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += self.value[k][at]
        return out

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.full(len(f), self.start)
        return np.interp(self.margin(f), self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; each block at the mean of its x, with a half count of either class as a prior."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a2, b2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + n2]
    xs = np.array([b[0] / b[2] for b in blocks])
    ys = np.array([(b[1] + 0.5) / (b[2] + 1.0) for b in blocks])
    return xs, np.maximum.accumulate(ys)


def boost(f: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Booster:
    """f: features, y: 0/1, calibrate: which rows only calibrate."""
    train = ~calibrate
    empty = np.empty(0)
    if not len(y) or y.min() == y.max() or y[train].min(initial=1) == y[train].max(initial=0):
        return Booster(float(y.mean()) if len(y) else 0.0, np.empty((0, 1), np.int64), empty, empty, empty, empty)
    ft, yt = f[train], y[train]
    edges = [np.unique(np.quantile(ft[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(f.shape[1])]
    edges = [np.unique(np.append(e, [0.0])) if len(e) else np.array([0.0]) for e in edges]
    binned = np.stack([np.searchsorted(e, ft[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    start = float(np.log(yt.mean() / (1 - yt.mean())))
    m, nodes = np.full(len(yt), start), 2 ** (DEPTH + 1) - 1
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-m))
        g, h = yt - p, p * (1 - p)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(yt), dtype=np.int64)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = RATE * gs / (hs + 1.0)
            if node >= 2**DEPTH - 1 or len(mine) < 10:
                continue
            best = (1e-3, -1, 0)
            for j, e in enumerate(edges):
                gl = np.cumsum(np.bincount(binned[mine, j], weights=g[mine], minlength=len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[mine, j], weights=h[mine], minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
                at[mine] = 2 * node + 1 + (binned[mine, best[1]] > best[2])
        m = m + value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    b = Booster(start, np.array(features), np.array(thresholds), np.array(values), empty, empty)
    use = calibrate if calibrate.any() and y[calibrate].min() != y[calibrate].max() else train
    xs, ys = isotonic(b.margin(f[use]), y[use])
    return Booster(b.start, b.feature, b.threshold, b.value, xs, ys)


CALIBRATE, PARTS = 2, 3
"""The part that calibrates, and the number of parts."""


def part(doc_id: Column) -> Column:
    """0 and 1 learn, each by two fifths of the rows; CALIBRATE is the last fifth."""
    return F.floor(F.pmod(F.crc32(F.concat(doc_id.cast("string"), F.lit("/part"))), F.lit(5)) / 2).cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, Booster]:
    """docs (doc_id, text), labels (doc_id, toxic); held-out rows take no part. At most `sample` texts reach any step."""
    labelled = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")  # two numbers a row, so fit to broadcast
    texts = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = stored(texts.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("y"), part(F.col("doc_id")).alias("p")), "labelled-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, str], int] = Counter()
        for b in batches:
            for t, y, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.update((y, p, w) for w in tokens_of(t))
            if len(held) > 200_000:
                yield from told(held)
                held.clear()
        yield from told(held)

    def told(held: dict[tuple[int, int, str], int]) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        if keys:
            y, p, w = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(p, pa.int32()), pa.array(w), pa.array(list(held.values()), pa.int64())], ["y", "p", "w", "n"])

    size = {(r.y, r.p): r.n for r in rows.groupBy("y", "p").agg(F.count("*").alias("n")).collect()}
    n = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n")).otherwise(0))
    counts = rows.where(F.col("p") != CALIBRATE).select("text", "y", "p").mapInArrow(count, "y int, p int, w string, n long").groupBy("w").agg(*[n(y, p).alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)])
    by_part = [telling(F.col(f"n1{p}"), F.col(f"n0{p}"), size.get((1, p), 0), size.get((0, p), 0)) for p in (0, 1)]
    whole = telling(F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01"), *(size.get((y, 0), 0) + size.get((y, 1), 0) for y in (1, 0)))
    found = counts.select("w", *[c.alias(f"in{i}") for i, c in enumerate([*by_part, whole])]).where("in0 OR in1 OR in2").orderBy("w").collect()  # words of the bounded sample
    lexicons = [lexicon_of([r.w for r in found if r[f"in{i}"]]) for i in range(PARTS)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a learning row is described by the other part's lexicon, a calibrating one by that of both
        x = [Extractor(lexicons[i]) for i in (1, 0, 2)]
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[p](t) for p, t in pairs], pa.list_(pa.float64()))], ["doc_id", "y", "p", "f"])

    got = rows.select("doc_id", "y", "p", "text").mapInArrow(extract, "doc_id long, y int, p int, f array<double>").orderBy("doc_id").collect()  # at most `sample` rows
    f = np.array([r.f for r in got]).reshape(-1, len(FEATURES))
    return lexicons[PARTS - 1], boost(f, np.array([r.y for r in got], dtype=float), np.array([r.p == CALIBRATE for r in got], dtype=bool))


def predict(docs: DataFrame, model: tuple[Lexicon, Booster]) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, booster = held.value
        x = Extractor(lexicon)
        for b in batches:
            s = np.clip(booster.score(np.array([x(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document; learnt from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return predict(docs, fit(docs, labels)).select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
