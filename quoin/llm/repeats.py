"""Which windows of a corpus repeat, decided exactly and without sending the windows.

1. Texts are keyed by a 128-bit hash, equal texts of a map task are merged, and the rest is
   dealt to chunks by key.  A chunk sends each of its distinct segment fingerprints (see
   segments.py) once to the bucket of the fingerprint, so a passage that stands in a third of
   all documents still is one entry per chunk.
2. A bucket sorts what it got and answers each chunk with one byte for each entry: unique,
   repeated, or open (the anchor is shared, but the segment is not).
3. For open segments only, chunks send what a verifier packs (window hashes or bytes) and get
   back which windows repeat.
4. Chunks mark the covered units.

The exchange of the texts is the same in each step, so Spark runs it once and reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as S
from .shared import CHUNK_BYTES, count_of, shuffle_partitions, text_key, tidy

UNIQUE, REPEATED, OPEN, SHOWN, HOT_OPEN, HOT_SHOWN = 0, 1, 2, 3, 4, 5
"""Answers: SHOWN is repeated, and this chunk sends the segment for open ones to compare with. HOT: of an anchor
with very many different segments."""

TEXTS = "chunk int, h1 long, h2 long, text string, m long"
BLOBS = "chunk int, bucket int, kind int, data binary"


def chunked(docs: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """Distinct texts (null left out) with their number m, as TEXTS. m is 0 for what only adds to a count."""
    n = n or count_of(docs, text, CHUNK_BYTES, shuffle_partitions(docs.sparkSession))
    h1, h2 = text_key(F.col(text))
    source = docs.where(F.col(text).isNotNull()).select(F.pmod(h1, F.lit(n)).cast("int").alias("chunk"), h1.alias("h1"), h2.alias("h2"), F.col(text).cast("string").alias("text"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        names = ["chunk", "h1", "h2", "text", "m"]
        for b in batches:
            new = []
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in ("chunk", "h1", "h2")), strict=True)):
                if key in seen:
                    seen[key] += 1
                else:
                    seen[key] = 0
                    new.append(i)
            part = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(k).cast(t) for k, t in zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=False)] + [pa.array(np.ones(len(new), dtype=np.int64))], names)
        more = [(*k, v) for k, v in seen.items() if v]
        if more:
            c, a, b2, m = zip(*more, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(a, pa.int64()), pa.array(b2, pa.int64()), pa.nulls(len(more), pa.string()), pa.array(m, pa.int64())], names)

    # one row a text in its chunk: what several map tasks hold is reduced while it streams, before a chunk is loaded
    return source.mapInArrow(merge, TEXTS).repartition("chunk").groupBy("chunk", "h1", "h2").agg(F.max("text").alias("text"), F.sum("m").alias("m"))


def texts_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Keys (n x 2), texts and numbers of a chunk, one row for each text, in the order of the keys."""
    tidy()
    h = np.stack([table.column("h1").to_numpy(), table.column("h2").to_numpy()], axis=1)
    m = table.column("m").to_numpy()
    absent = table.column("text").is_null().to_numpy()
    order = np.lexsort((absent, h[:, 1], h[:, 0]))
    h, m = h[order], m[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    text = table.column("text").cast(pa.large_binary()).take(pa.array(order[first]))
    return h[first], text.to_pylist(), np.add.reduceat(m, first) if len(m) else m


class Chunk:
    """A chunk's texts, segments and distinct entries; each step computes the same ones again."""

    def __init__(self, spec: S.Spec, table: pa.Table):
        self.spec = spec
        self.keys, self.texts, self.m = texts_of(table)
        self.units = S.units(spec, self.texts)
        self.seg = s = S.segments(spec, self.units)
        text = np.searchsorted(self.units.bounds, s.first, side="right") - 1
        keys = (s.g, s.c, s.d)
        order = in_order(keys)
        new = starts_of(keys, order)
        self.keyed = tuple(k[order][new] for k in keys)
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        weight = np.minimum(self.m, 2)[text] if len(text) else np.empty(0, dtype=np.int64)
        self.w = np.minimum(np.bincount(self.of, weights=weight, minlength=int(new.sum())), 2).astype(np.uint8)
        self.first_of = order[new]

    def answers(self, table: pa.Table, kind: int) -> np.ndarray:
        """The replies of one kind, in the order of what was sent (buckets are ranges of it)."""
        rows = sorted((b, d) for b, k, d in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind)
        return np.frombuffer(b"".join(d for _, d in rows), dtype=np.uint8)


def ranges(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of the non-empty buckets; buckets are equal ranges of the hash."""
    if not len(sorted_hashes):
        return []
    of = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return [(int(of[lo]), int(lo), int(hi)) for lo, hi in zip(at, [*at[1:], len(of)], strict=True)]


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    c, b, k, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(d, pa.binary())})


Keys = tuple[np.ndarray, ...]
"""Columns of 64-bit numbers that together are a key; a run is such columns in order, with a weight of each row."""


def pack(keys: Keys, w: np.ndarray) -> bytes:
    return b"".join(k.tobytes() for k in keys) + w.astype(np.uint8).tobytes()


def unpack(data: list[bytes], width: int) -> tuple[Keys, np.ndarray, list[int]]:
    sizes = [len(d) // (8 * width + 1) for d in data]
    keys = tuple(np.concatenate([np.frombuffer(d, np.uint64, n, 8 * n * i) for d, n in zip(data, sizes, strict=True)] or [np.empty(0, np.uint64)]) for i in range(width))
    return keys, np.concatenate([np.frombuffer(d, np.uint8, n, 8 * n * width) for d, n in zip(data, sizes, strict=True)] or [np.empty(0, np.uint8)]), sizes


def in_order(keys: Keys) -> np.ndarray:
    """The order of the rows. The stable sort is a natural merge: of sorted runs that lie one after the other, each is
    found as such and they are merged, not sorted anew; only rows of equal first numbers are compared further."""
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    tied = np.zeros(len(first), dtype=bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        order[at] = rows[np.lexsort(tuple(k[rows] for k in keys[::-1]))]
    return order


def starts_of(keys: Keys, order: np.ndarray) -> np.ndarray:
    """Which rows in order differ from the row before."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return new


def totals(keys: Keys, w: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Distinct rows in order, with their number (2 stands for two or more): a sorted run, by merging those given."""
    order = in_order(keys)
    new = starts_of(keys, order)
    at = np.flatnonzero(new)
    n = np.minimum(np.add.reduceat(w[order].astype(np.int64), at), 2) if len(at) else np.empty(0, np.int64)
    return tuple(k[order][at] for k in keys), n.astype(np.uint8)


def judge(ask: list[bytes], known: tuple[Keys, np.ndarray] | None, hot: int | None = None) -> list[bytes]:
    """One answer for each entry asked. known: the run to judge by; without one, the entries asked. hot: anchors with more
    different segments are answered as HOT."""
    keys, w, sizes = unpack(ask, 3)
    run, kw = totals(keys, w) if known is None else known
    order = in_order(keys)
    new = starts_of(keys, order)
    first = np.zeros(len(order), dtype=bool)  # of equal entries the first asker shows it
    first[order] = new
    ids = np.empty(len(order), dtype=np.int64)
    ids[order] = np.cumsum(new) - 1
    asked = tuple(k[order][new] for k in keys)
    kg = run[0]
    begin = np.flatnonzero(np.r_[True, kg[1:] != kg[:-1]]) if len(kg) else np.empty(0, np.int64)
    kinds = np.diff(np.append(begin, len(kg)))
    single = np.add.reduceat((kw < 2).astype(np.int64), begin) > 0 if len(kg) else np.empty(0, bool)
    of = np.searchsorted(kg[begin], asked[0])
    repeated = kw[merge_join(run, asked)] >= 2
    mixed = (kinds[of] > 1) & single[of]
    state = np.where(repeated, np.where(mixed, SHOWN, REPEATED), np.where(mixed, OPEN, UNIQUE)).astype(np.uint8)
    if hot is not None:
        state[(state >= OPEN) & (kinds[of] > hot)] += HOT_OPEN - OPEN
    out = state[ids]
    out[((out == SHOWN) | (out == HOT_SHOWN)) & ~first] = REPEATED
    return [out[e - n : e].tobytes() for n, e in zip(sizes, np.cumsum(sizes, dtype=np.int64), strict=True)]


def merge_join(run: Keys, asked: Keys) -> np.ndarray:
    """Positions in the sorted run of the sorted rows asked about, which it must hold: both are merged."""
    n = len(run[0])
    order = in_order(tuple(np.r_[k, q] for k, q in zip(run, asked, strict=True)))
    is_ask = order >= n
    out = np.empty(len(asked[0]), dtype=np.int64)
    out[order[is_ask] - n] = (np.cumsum(~is_ask) - 1)[is_ask]
    if len(out) and not all((k[out] == q).all() for k, q in zip(run, asked, strict=True)):
        raise ValueError("the run lacks entries of the texts that are judged by it")
    return out


class HashVerify:
    """Compares open windows by 128 bits of their own; equal windows have equal anchors besides."""

    KIND = 1

    def __init__(self, open_: int = OPEN, shown: int = SHOWN):
        self.open, self.shown = open_, shown

    def windows(self, chunk: Chunk, states: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct open windows, in order: hashes, numbers; starts of the open ones and which entry each is."""
        s = chunk.seg
        st = states[chunk.of] if len(states) else np.empty(0, np.uint8)
        shown = np.zeros(len(st), dtype=bool)
        shown[chunk.first_of] = True
        open_, show = st == self.open, (st == self.shown) & shown
        starts = S.expand(s.first[open_ | show], s.last[open_ | show])
        is_open = np.repeat(open_[open_ | show], (s.last - s.first + 1)[open_ | show])
        order = np.argsort(starts, kind="stable")
        starts, is_open = starts[order], is_open[order]
        keys = S.window_hashes(chunk.spec, chunk.units, starts)
        order = in_order(keys)
        new = starts_of(keys, order)
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        w = np.minimum(np.bincount(of, weights=np.where(is_open, 1, 2), minlength=int(new.sum())), 2).astype(np.uint8)
        return tuple(k[order][new] for k in keys), w, starts[is_open], of[is_open]

    def ask(self, chunk: Chunk, states: np.ndarray, number: int, buckets: int) -> list[tuple[int, int, int, bytes]]:
        keys, w, _, _ = self.windows(chunk, states)
        return [(number, b, self.KIND, pack(tuple(k[lo:hi] for k in keys), w[lo:hi])) for b, lo, hi in ranges(keys[0], buckets)]

    def judge(self, ask: list[bytes], known: tuple[Keys, np.ndarray] | None = None) -> list[bytes]:
        """Which of the windows asked about repeat: among themselves, or by a run (known) that holds them all."""
        keys, w, sizes = unpack(ask, 2)
        order = in_order(keys)
        new = starts_of(keys, order)
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.cumsum(new) - 1
        if known is None:
            out = (np.bincount(ids, weights=w) >= 2).astype(np.uint8)[ids]
        else:
            out = (known[1][merge_join(known[0], tuple(k[order][new] for k in keys))] >= 2).astype(np.uint8)[ids]
        return [out[e - n : e].tobytes() for n, e in zip(sizes, np.cumsum(sizes, dtype=np.int64), strict=True)]

    def repeated(self, chunk: Chunk, states: np.ndarray, answers: np.ndarray) -> np.ndarray:
        """Starts of the open windows that repeat."""
        _, _, starts, of = self.windows(chunk, states)
        return starts[answers[of] > 0] if len(starts) else starts


def marked(
    texts: DataFrame, spec: S.Spec, finish: Callable[[Chunk, np.ndarray], pa.Table], schema: str, run: DataFrame | None = None, verify: tuple = (HashVerify(),), buckets: int | None = None, hot: int | None = None, windows: DataFrame | None = None, window_buckets: int | None = None
) -> DataFrame:
    """finish(chunk, which units repeated windows cover) for each chunk of `texts` (see chunked).

    run: (bucket int, data binary) of an index of `buckets` buckets that holds all of `texts`; without one,
    the texts are judged among themselves. windows: the same, of `window_buckets` buckets, for the index's windows (verify
    must be HashVerify then); without it, open windows are compared among `texts` only.
    """
    buckets = buckets or shuffle_partitions(texts.sparkSession)
    held = texts.groupBy("chunk")

    def number(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def ask(table: pa.Table) -> pa.Table:
        c, n = Chunk(spec, table), number(table)
        return blobs([(n, b, 0, pack(tuple(k[lo:hi] for k in c.keyed), c.w[lo:hi])) for b, lo, hi in ranges(c.keyed[0], buckets)])

    def answer(table: pa.Table, known: tuple | None = None) -> pa.Table:
        order = sorted(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True))
        return blobs([(c, b, 0, d) for (c, b, _), d in zip(order, judge([x[2] for x in order], known, hot), strict=True)])

    def answer_by_run(table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blobs([])
        return answer(table, totals(*unpack(runs.column("data").to_pylist(), 3)[:2]))

    asked = held.applyInArrow(ask, BLOBS).groupBy("bucket")
    first = asked.applyInArrow(lambda t: answer(t), BLOBS) if run is None else asked.cogroup(run.groupBy("bucket")).applyInArrow(answer_by_run, BLOBS)

    def ask_open(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return blobs([])
        c = Chunk(spec, table)
        states = c.answers(replies, 0)
        return blobs([row for v in verify for row in v.ask(c, states, number(table), window_buckets or buckets)])

    def answer_open_by_run(table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blobs([])
        return answer_open(table, (totals(*unpack(runs.column("data").to_pylist(), 2)[:2]),))

    def answer_open(table: pa.Table, known: tuple = ()) -> pa.Table:
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("kind", "chunk", "bucket", "data")), strict=True))
        out = []
        for v in verify:
            mine = [r for r in rows if r[0] == v.KIND]
            out += [(c, b, k, d) for (k, c, b, _), d in zip(mine, v.judge([r[3] for r in mine], *known) if mine else [], strict=True)]
        return blobs(out)

    asked_open = held.cogroup(first.groupBy("chunk")).applyInArrow(ask_open, BLOBS).groupBy("bucket")
    second = asked_open.applyInArrow(lambda t: answer_open(t), BLOBS) if windows is None else asked_open.cogroup(windows.groupBy("bucket")).applyInArrow(answer_open_by_run, BLOBS)

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], finish_schema)
        c = Chunk(spec, table)
        states = c.answers(replies, 0)
        st = states[c.of] if len(states) else np.empty(0, np.uint8)
        whole = (st == REPEATED) | (st == SHOWN) | (st == HOT_SHOWN)
        starts = S.expand(c.seg.first[whole], c.seg.last[whole])
        more = [v.repeated(c, states, c.answers(replies, v.KIND)) for v in verify]
        return finish(c, S.covered(len(c.units.values), spec.window, np.concatenate([starts, *more]).astype(np.int64)))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    finish_schema = to_arrow_schema(StructType.fromDDL(schema))
    return held.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(last, schema)
