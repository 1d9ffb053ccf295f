"""Operator 2: suffix-array dedup by prefix-free parsing.

Phrases. Rolling-hash triggers (the least of each run of 105 hashes of 96 bytes) cut texts into phrases that overlap by
199 bytes, so each string of 200 bytes lies in one phrase and, wherever it stands, at the same place relative to its
trigger. The dictionary of distinct phrases with their counts is dealt to buckets by trigger: a phrase that occurs twice
repeats as a whole, and one whose trigger occurs once does not repeat at all.

Order. Only phrases with a shared trigger but different bytes are left (in ordinary corpora the ends of copies). A
bucket parses these again into short phrases by rolling-hash triggers, makes the suffix arrays of their dictionary and
of their parse by prefix doubling, and combines them: a suffix is ordered by the rank of the rest of its phrase and then
by the rank of the parse that follows. Neighbours in this order that agree in 200 bytes, byte by byte, repeat. Lots are
bounded (LOT bytes, whole triggers), as is a trigger's share: the strings of triggers with more than HOT different
phrases are compared by 128 bits of hash over all buckets instead, so that no trigger has to fit into one task. The result
is the same either way. A phrase of the dictionary is known by a BLAKE2b digest of its bytes.

Null texts are empty; texts under 200 bytes lose nothing; texts of any length are taken whole, in slices; repeated rows are
repeats of each other; an empty table gives an empty result. Only text is read, so other columns, whatever their names, play
no part (those named as a result are replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from . import repeats as R
from . import segments as S
from .shared import CHUNK_BYTES, count_of, fresh, shuffle_partitions, text_key

RESULT = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
LOT = 1 << 18
HOT = 4096
BUCKET_TEXT = 256 << 20
"""Bytes of text whose phrases one bucket compares."""
GRAM, MODULUS = 8, 24


def ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of integer keys, and how many."""
    u, r = np.unique(keys, return_inverse=True)
    return r.astype(np.int64), len(u)


def doubled(symbols: np.ndarray, most: int) -> np.ndarray:
    """Ranks of all suffixes of an integer sequence by prefix doubling, up to `most` symbols deep at least."""
    r, n = ranks(symbols)
    k = 1
    while n < len(r) and k < most:
        following = np.full(len(r), -1, dtype=np.int64)
        following[:-k] = r[k:]
        r, n = ranks(r * (len(r) + 2) + following + 1)
        k *= 2
    return r


def corpus_order(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the concatenated strings, of the substrings of `window` bytes, in the order of the suffixes there;
    and whether each equals the one before it in its first `window` bytes."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    ends = np.cumsum(size)
    begins = ends - size
    # triggers: where the hash of GRAM bytes inside one string is 0 modulo MODULUS; every string opens a phrase
    n = len(data) - GRAM + 1
    hit = np.zeros(len(data), dtype=bool)
    if n > 0:
        hit[:n] = H.Rolling(H.BYTE_VALUES[1][data], 1).fixed(GRAM) % np.uint64(MODULUS) == 0
    left = np.repeat(ends, size) - np.arange(len(data))
    hit &= left > GRAM
    hit[begins] = True
    first = np.flatnonzero(hit)
    of = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.append(first[1:], len(data)) + GRAM, ends[of])  # phrases end with the next trigger
    final = np.append(of[1:] != of[:-1], True)
    last[final] = ends[of[final]]
    # dictionary of distinct phrases
    seen: dict[bytes, int] = {}
    raw = data.tobytes()
    phrase = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.int64)
    words = list(seen)
    length = np.array([len(w) for w in words], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(length + 1)])
    text = np.zeros(int(at[-1]), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[at[1:] - 1] = False  # an end sign, the least symbol, closes each phrase
    text[inside] = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64) + 1
    # suffix array of the dictionary: equal suffixes of phrases must have equal ranks, so what follows an end sign must not count
    dictionary = phrase_ranks(text, at, int(length.max(initial=1)) + 1)
    # suffix array of the parse; end signs part the strings
    order_of = dictionary[at[:-1]]
    parse = np.zeros(len(phrase) + len(strings), dtype=np.int64)
    place = np.arange(len(phrase)) + of
    parse[place] = order_of[phrase] + 1
    parse_rank = doubled(parse, window)
    # combine: rank of the rest of the phrase, then of the parse after it
    starts = np.flatnonzero(left >= window)
    p = np.searchsorted(first, starts, side="right") - 1
    rest = dictionary[at[phrase[p]] + (starts - first[p])]
    following = parse_rank[place[p] + 1]
    order = np.lexsort((following, rest))
    starts = starts[order]
    same = np.zeros(len(starts), dtype=bool)
    view = np.lib.stride_tricks.sliding_window_view(data, window) if len(data) >= window else None
    for lo in range(1, len(starts), 16_384):
        hi = min(lo + 16_384, len(starts))
        same[lo:hi] = (view[starts[lo:hi]] == view[starts[lo - 1 : hi - 1]]).all(axis=1)
    return starts, same


def phrase_ranks(text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Ranks of all phrase suffixes in the dictionary's text, compared up to their end signs."""
    r, n = ranks(text)
    stop = np.repeat(at[1:] - 1, np.diff(at))  # place of the end sign of each symbol's phrase
    k, here = 1, np.arange(len(text))
    while k < most:
        there = here + k
        following = np.where(there <= stop, r[np.minimum(there, len(r) - 1)], -1)
        r, m = ranks(r * (len(r) + 2) + following + 1)
        if m == n and k > 1:
            break
        n, k = m, 2 * k
    return r


class SuffixVerify:
    """Settles open phrases of the same bucket by their order; answers one byte for each string of an open phrase."""

    KIND = 2

    @staticmethod
    def chosen(chunk: R.Chunk, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments to send, in the order of their triggers, and which of them are open."""
        st = states[chunk.of] if len(states) else np.empty(0, np.uint8)
        shown = np.zeros(len(st), dtype=bool)
        shown[chunk.first_of] = True
        at = np.flatnonzero((st == R.OPEN) | ((st == R.SHOWN) & shown))
        at = at[np.lexsort((chunk.seg.first[at], chunk.seg.g[at]))]
        return at, st[at] == R.OPEN

    def ask(self, chunk: R.Chunk, states: np.ndarray, number: int, buckets: int) -> list[tuple[int, int, int, bytes]]:
        at, open_ = self.chosen(chunk, states)
        s, raw = chunk.seg, chunk.units.raw
        g, n = s.g[at], (s.last - s.first + 1)[at].astype(np.int32)
        out = []
        for b, lo, hi in R.ranges(g, buckets):
            body = b"".join(raw[s.first[i] : s.last[i] + chunk.spec.window] for i in at[lo:hi])
            out.append((number, b, self.KIND, np.int64(hi - lo).tobytes() + g[lo:hi].tobytes() + n[lo:hi].tobytes() + open_[lo:hi].astype(np.uint8).tobytes() + body))
        return out

    def judge(self, ask: list[bytes]) -> list[bytes]:
        window = S.BYTES.window
        g, n, open_, text, owner = [], [], [], [], []
        for k, d in enumerate(ask):
            m = int(np.frombuffer(d, np.int64, 1)[0])
            g.append(np.frombuffer(d, np.uint64, m, 8))
            n.append(np.frombuffer(d, np.int32, m, 8 + 8 * m).astype(np.int64))
            open_.append(np.frombuffer(d, np.uint8, m, 8 + 12 * m).astype(bool))
            at = 8 + 13 * m
            for x in n[-1].tolist():
                text.append(d[at : at + x + window - 1])
                at += x + window - 1
            owner += [k] * m
        g, n, open_ = np.concatenate(g), np.concatenate(n), np.concatenate(open_)
        order = np.argsort(g, kind="stable")
        sizes = (n + window - 1)[order]
        answers: list[bytes] = [b""] * len(order)
        lot: list[int] = []
        held = 0
        for i, k in enumerate(order):
            lot.append(int(k))
            held += int(sizes[i])
            if i + 1 == len(order) or (held >= LOT and g[order[i + 1]] != g[k]):
                self._settle(lot, text, n, open_, answers, window)
                lot, held = [], 0
        out: list[list[bytes]] = [[] for _ in ask]
        for k, a in zip(owner, answers, strict=True):
            out[k].append(a)
        return [b"".join(x) for x in out]

    @staticmethod
    def _settle(lot: list[int], text: list[bytes], n: np.ndarray, open_: np.ndarray, answers: list[bytes], window: int) -> None:
        starts, same = corpus_order([text[k] for k in lot], window)
        ends = np.cumsum(n[lot] + window - 1)
        of = np.searchsorted(ends, starts, side="right")
        run = np.cumsum(~same) - 1
        weight = np.where(open_[lot][of], 1, 2)
        repeated = np.bincount(run, weights=weight)[run] >= 2
        flags = np.zeros(int(ends[-1]), dtype=np.uint8)
        flags[starts] = repeated
        for i, k in enumerate(lot):
            begin = int(ends[i]) - len(text[k])
            answers[k] = flags[begin : begin + int(n[k])].tobytes() if open_[k] else b""

    def repeated(self, chunk: R.Chunk, states: np.ndarray, answers: np.ndarray) -> np.ndarray:
        at, open_ = self.chosen(chunk, states)
        at = at[open_]
        starts = S.expand(chunk.seg.first[at], chunk.seg.last[at])
        return starts[answers > 0] if len(starts) else starts


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """docs without the text column's repeated strings: n_bytes, n_removed, n_spans, kept_sha256 (replacing columns of
    these names)."""

    def finish(c: R.Chunk, covered: np.ndarray) -> pa.Table:
        rows = []
        for i, t in enumerate(c.texts):
            gone = covered[c.units.bounds[i] : c.units.bounds[i + 1]]
            n = int(gone.sum())
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if n else 0
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if n else t
            rows.append((int(c.keys[i, 0]), int(c.keys[i, 1]), len(t), n, spans, hashlib.sha256(kept).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    a, b, f = fresh(docs, "h1", "h2", "found")
    verify = (SuffixVerify(), R.HashVerify(R.HOT_OPEN, R.HOT_SHOWN))
    partitions = shuffle_partitions(docs.sparkSession)
    chunks = count_of(docs, text, CHUNK_BYTES, partitions)
    buckets = max(partitions, chunks * CHUNK_BYTES // BUCKET_TEXT)
    found = R.marked(R.chunked(docs, text, chunks), S.BYTES, finish, RESULT, verify=verify, hot=hot, buckets=buckets)
    found = found.select(F.col("h1").alias(a), F.col("h2").alias(b), F.struct(*new).alias(f))
    old = [c for c in docs.columns if c.lower() not in new]
    h1, h2 = text_key(F.col(text))
    zero = F.lit(0).cast("long")
    return docs.withColumns({a: h1, b: h2}).join(found, [a, b], "left").select(
        *[F.col(f"`{c}`") for c in old], *[F.coalesce(f"{f}.{c}", zero).alias(c) for c in new[:3]], F.coalesce(f"{f}.kept_sha256", F.lit(EMPTY_SHA)).alias("kept_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row for each document; strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
