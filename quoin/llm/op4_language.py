"""Operator 4: language identification with bit-sliced Bloom filters over byte n-grams.

One slot of the filter is a bitmask with a bit for each language; the AND of an n-gram's slots names all languages
that contain it. A text's bits are summed by language, the expected share of false positives is taken off, and the
largest count decides (ties: the first language in order of names).

Learning: n-gram counts over all training texts, summed by Spark; an n-gram enters the filter of every language of whose
n-grams it is at least LEAST_SHARE. So a language has at most 1 / LEAST_SHARE of them, however large the corpus is, and no
language's n-grams have to be sorted. Null text or text without a letter: 'und', score 0. Without training rows all is
'und'. An empty table gives an empty result; repeated rows get equal results; long texts are walked in slices that overlap,
so each n-gram is counted once; other columns, whatever their names, play no part and may be kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .shared import cut, fresh

LEAST_SHARE = 1e-5
SLOTS_PER_GRAM = 16
SLICE = 1 << 19
"""Bytes that are walked at once."""
PROBES = 3
GRAM = 4
_PAD = b"   "
_BLANK = 0x20202020


def _fold() -> np.ndarray:
    t = np.full(256, 0x20, dtype=np.uint8)
    for b in range(256):
        if 0x61 <= b <= 0x7A or b >= 0x80:
            t[b] = b
        elif 0x41 <= b <= 0x5A:
            t[b] = b + 0x20
    return t


FOLD = _fold()


def folded(raw: bytes) -> np.ndarray:
    """Bytes in lower case, with other ASCII as blanks."""
    out = FOLD[np.frombuffer(raw, dtype=np.uint8)]
    upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[1:][upper] += 0x20
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """The 4-byte n-grams of folded bytes, by start."""
    n = len(raw) - GRAM + 1
    wide = raw.astype(np.uint32)
    return wide[:n] | wide[1 : n + 1] << 8 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 24


def pieces(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, first n-gram of each text, its index) of groups of texts of about `most` bytes. Each text stands between
    blanks, which neighbours share; of a longer text the slices overlap by what an n-gram needs."""
    group, index, size = [], [], 0

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return grams(folded(_PAD + _PAD.join(group) + _PAD)), np.concatenate([[0], np.cumsum([len(t) + 3 for t in group[:-1]], dtype=np.int64)]), np.array(index)

    for i, t in enumerate(texts):
        if len(t) > most:
            raw = folded(_PAD + t + _PAD)
            for at in range(0, len(raw) - GRAM + 1, most):
                yield grams(raw[at : at + most + GRAM - 1]), np.zeros(1, np.int64), np.array([i])
            continue
        if size and size + len(t) > most:
            yield told()
            group, index, size = [], [], 0
        group.append(t)
        index.append(i)
        size += len(t)
    if group:
        yield told()


@dataclass(frozen=True)
class Model:
    """languages in order; table: bitmask of each slot; rate: false positives by language."""

    languages: tuple[str, ...]
    table: np.ndarray
    rate: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Model:
        names = tuple(sorted(members))
        words = max(1, -(-len(names) // 64))
        total = max(1, sum(len(v) for v in members.values()))
        slots = 1 << max(10, (total * SLOTS_PER_GRAM // max(1, len(names)) * 2 - 1).bit_length())
        table = np.zeros((words, slots), dtype=np.uint64 if len(names) > 8 else np.uint8)
        for i, name in enumerate(names):
            for at in probes(members[name], slots):
                np.bitwise_or.at(table[i // 64], at, table.dtype.type(1 << (i % 64)))
        fill = np.array([np.count_nonzero(table[i // 64] >> table.dtype.type(i % 64) & table.dtype.type(1)) / slots for i in range(len(names))])
        return cls(names, table, fill**PROBES)

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits (texts x languages) and grams looked up."""
        hits = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for g, bounds, index in pieces(texts):
            told = g != _BLANK
            at = probes(g, self.table.shape[1])
            masks = [np.bitwise_and.reduce([w[a] for a in at]) for w in self.table]
            np.add.at(n, index, np.add.reduceat(told.astype(np.int64), bounds))
            for i in range(len(self.languages)):
                m = masks[i // 64]
                bit = (m >> m.dtype.type(i % 64) & m.dtype.type(1)).astype(bool) & told
                np.add.at(hits[:, i], index, np.add.reduceat(bit.astype(np.int64), bounds))
        return np.clip((hits - n[:, None] * self.rate) / (1 - self.rate), 0, None), n


def probes(g: np.ndarray, slots: int) -> list[np.ndarray]:
    h = H.mix(g.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def fit(train: DataFrame, text: str, lang: str, least_share: float = LEAST_SHARE) -> Model:
    """train: rows with non-null text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            texts, langs = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()
            for name in set(langs):
                for g, _, _ in pieces([t for t, x in zip(texts, langs, strict=True) if x == name]):
                    u, c = np.unique(g, return_counts=True)
                    parts = held.setdefault(name, [])
                    parts.append((u, c))
                    if len(parts) > 16:
                        held[name] = [merged(parts)]
        for name, parts in held.items():
            u, c = merged(parts)
            for at in range(0, len(u), 50_000):
                x, y = u[at : at + 50_000], c[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], ["lang", "gram", "n"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)

    sums = train.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    sums = cut(sums.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("gram") != _BLANK))
    least = sums.groupBy("lang").agg((F.sum("n") * least_share).alias("least"))
    rows = sums.join(least, "lang").where("n >= least").select("lang", "gram").toArrow()  # at most 1 / least_share a language
    langs, g = np.array(rows["lang"].to_pylist(), dtype=object), rows["gram"].to_numpy()
    return Model.build({name: np.sort(g[langs == name]).astype(np.uint32) for name in sorted(set(langs))})


def learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """`keep` columns with `names`: language, score (the best count's share of the two best) and coverage (of the n-grams)."""
    from pyspark.sql.types import StructField, StructType

    letter, body = fresh(docs, "has_letter", "body")
    whole = F.col(f"`{text}`").cast("string")
    safe = [f"keep_{i}" for i in range(len(keep))]  # names that mapInArrow can resolve
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, safe, strict=True)], whole.alias(body), F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias(letter))
    out = StructType([StructField(k, docs.schema[c].dataType) for c, k in zip(keep, safe, strict=True)] + StructType.fromDDL("pred string, told double, cover double").fields)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [t or b"" for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            ok = np.array(b.column(len(keep) + 1).to_pylist(), dtype=bool) & bool(m.languages)
            pred, score, cover = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            at = np.flatnonzero(ok)
            if len(at):
                hits, n = m.counts([texts[i] for i in at])
                best = hits.argmax(axis=1)
                two = np.sort(np.concatenate([hits, np.zeros((len(at), 1))], axis=1), axis=1)[:, -2:]
                total = two.sum(axis=1)
                score[at] = np.divide(two[:, 1], total, out=np.zeros(len(at)), where=total > 0)
                cover[at] = np.clip(np.divide(two[:, 1], n, out=np.zeros(len(at)), where=n > 0), 0, 1)
                for i, k in zip(at, best, strict=True):
                    pred[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(pred), pa.array(score), pa.array(cover)], names=out.names)

    return source.mapInArrow(run, out).toDF(*keep, *names)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    train = docs.where(learnable(F.col(f"`{doc_id}`")) & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    return predict(docs, fit(train, text, lang), text, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: a prediction for every document; learnt from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")
