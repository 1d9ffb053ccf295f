"""Operator 12: ranked lexical search by inverted treaps.

1. `index` walks every text once. Documents are gathered to slices of bounded size, in the order of doc_id within a slice; a
   slice is one row: its documents with their lengths, its terms with their document frequencies, and packed postings
   (document, occurrences). With `wanted`, a filter of fixed size (see `asked_terms`), only terms that may be asked for are
   kept; lengths count all terms.
2. `search` sums frequencies and lengths over all slices, gives each item's terms their weights, and meets items and slices
   in a grid: items in groups, slices in buckets, one task for each pair. A task makes a treap of each term's postings:
   search order is the document, heap order the impact (occurrences damped by length). An item's treaps are walked at once:
   a range of documents is bounded by the sum of its treaps' weighted root impacts; where that sum can enter the best k, the
   document at the root of most weight is scored exactly, and the range is split there. Else the range goes. Ranges of high
   bounds are walked first, and the k-th best score of the slices before bounds those that follow. The buckets' best k are
   merged by item.

A term is a maximal run of digits, ASCII letters and characters beyond ASCII; only A-Z are lower-cased. Null texts have none
and match nothing; neither do items that are null or without terms. Scores and lengths are whole numbers of 64 bits.
Equal scores are ordered by doc_id, documents without one last. Rows that repeat, or share a doc_id, are documents of their
own, as are items that share an item_id. Texts of any length are indexed whole. Empty tables give empty results. Only ids
and texts are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, stored, tidy

K = 10
SLICE_BYTES = 8 << 20
"""Text of a slice, or one document."""
SLICE_DOCS = 1 << 15
BUCKET_SLICES = 16
ITEM_GROUP = 1024
"""Items of a task: each slice is sent once for each group of them."""
FRONT = 1 << 17
"""Treap nodes that are walked at once."""
FILTER_BITS, PROBES = 1 << 22, 3
#: Fixed values of the score: scale of a weight; of an impact; damping of occurrences; share of length in hundredths.
WEIGHT, IMPACT, OCCURRENCE, DAMP, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 75


def _table() -> bytes:
    t = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            t[b] = b
        elif 0x41 <= b <= 0x5A:
            t[b] = b + 0x20
    return bytes(t)


_FOLD = _table()


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: what is no part of a term becomes a blank, so they are what is between blanks."""
    return text.translate(_FOLD).split()


def probes(term: bytes) -> list[int]:
    d = hashlib.blake2b(term, digest_size=4 * PROBES).digest()
    return [int.from_bytes(d[4 * i : 4 * i + 4], "little") % FILTER_BITS for i in range(PROBES)]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """row, item_id, term, times: the distinct terms of each item row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, i, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                out += [(row, i, term, n) for term, n in sorted(Counter(terms_of((t or "").encode())).items())]
            rows, ids, terms, times = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["row", "item_id", "term", "times"])

    source = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return stored(source.mapInArrow(run, "row long, item_id long, term binary, times long"), "item-terms")


def asked_terms(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the column `term`, FILTER_BITS however many there are: false hits cost work, never results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique([p for t in b.column(0).to_pylist() for p in probes(t)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["slot", "bits"])

    slots = terms.select("term").distinct().mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in slots:
        out[r.slot] = r.bits
    return out


INDEX = "slice long, ids array<long>, n array<long>, terms array<binary>, df array<long>, postings binary"


class Slices:
    """Gathers documents and packs them to slices."""

    def __init__(self, first: int, wanted: np.ndarray | None):
        self.next, self.wanted = first, wanted
        self.known: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids, self.n, self.size = [], [], 0
        self.code: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []

    def keeps(self, term: bytes) -> bool:
        if len(self.known) > 500_000:
            self.known.clear()
        yes = self.known[term] = all(int(self.wanted[p >> 6]) >> (p & 63) & 1 for p in probes(term))
        return yes

    def add(self, doc_id: int | None, text: bytes) -> bool:
        """Takes a document; tells whether the slice is full."""
        words = terms_of(text)
        if words:
            doc, code, known = len(self.ids), self.code, self.known
            counts = Counter(words)
            if self.wanted is not None:
                counts = {t: c for t, c in counts.items() if (known[t] if t in known else self.keeps(t))}
            self.term += [code.setdefault(t, len(code)) for t in counts]
            self.tf += counts.values()
            self.doc += [doc] * len(counts)
            self.ids.append(doc_id)
            self.n.append(len(words))
            self.size += len(text)
        return self.size >= SLICE_BYTES or len(self.ids) >= SLICE_DOCS

    def packed(self) -> pa.RecordBatch:
        last = np.iinfo(np.int64).max
        order = np.lexsort((np.arange(len(self.ids)), [last if i is None else i for i in self.ids], [i is None for i in self.ids]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.array(x, dtype=np.int64) for x in (self.term, self.doc, self.tf))
        by = np.lexsort((place[doc], term))
        df = np.bincount(term, minlength=len(self.code))
        data = np.stack([place[doc[by]], tf[by]]).astype(np.int32).tobytes()
        batch = pa.RecordBatch.from_arrays([
            pa.array([self.next]), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[self.n[i] for i in order]], pa.list_(pa.int64())),
            pa.array([list(self.code)], pa.list_(pa.binary())), pa.array([df], pa.list_(pa.int64())), pa.array([data], pa.binary()),
        ], ["slice", "ids", "n", "terms", "df", "postings"])
        self.next += 1
        self.clear()
        return batch


def index(docs: DataFrame, wanted: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The slices of all documents with a term, as INDEX."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Slices(TaskContext.get().partitionId() << 32, held.value)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t and s.add(i, t):
                    yield s.packed()
        if s.ids:
            yield s.packed()
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, INDEX)


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Treaps:
    """A treap for each term of a slice; nodes are the slice's postings, by term and document."""

    def __init__(self, n: np.ndarray, df: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, length: int):
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * v * n_docs // length for v in n.tolist()], dtype=np.int64)
        tf = tf.astype(np.int64)
        self.impact = (IMPACT * tf) // (OCCURRENCE * tf + DAMP * m[doc])
        self.doc, self.docs = doc.astype(np.int64), len(n)
        self.begin = np.concatenate([[0], np.cumsum(df)])
        self.key = np.repeat(np.arange(len(df)), df) * self.docs + self.doc
        self.left, self.right = np.full(len(doc), -1), np.full(len(doc), -1)
        self.root = np.full(len(df), -1)

    def grow(self, term: int) -> int:
        """The root of a term's treap, which is made when the term is first asked for; of equal impacts the first is above."""
        if self.root[term] < 0:
            lo, hi = int(self.begin[term]), int(self.begin[term + 1])
            impact = self.impact[lo:hi].tolist()
            left, right, spine = [-1] * (hi - lo), [-1] * (hi - lo), []
            for i, x in enumerate(impact):
                last = -1
                while spine and impact[spine[-1]] < x:
                    last = spine.pop()
                if last >= 0:
                    left[i] = last + lo
                if spine:
                    right[spine[-1]] = i + lo
                spine.append(i)
            self.left[lo:hi], self.right[lo:hi] = left, right
            self.root[term] = spine[0] + lo
        return int(self.root[term])

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The roots of what subtrees hold of documents between lo and hi, both excluded; -1: nothing."""
        flat, low, high = node.ravel().copy(), np.repeat(lo, node.shape[1]), np.repeat(hi, node.shape[1])
        at = np.flatnonzero(flat >= 0)
        while len(at):
            d = self.doc[flat[at]]
            over, under = d >= high[at], d <= low[at]
            flat[at] = np.where(over, self.left[flat[at]], np.where(under, self.right[flat[at]], flat[at]))
            at = at[(over | under) & (flat[at] >= 0)]
        return flat.reshape(node.shape)

    def scores(self, term: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Exact scores of documents, by row with its own terms (-1: none) and weights."""
        key = term * self.docs + doc[:, None]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (term >= 0), self.impact[at] * w, 0).sum(axis=1)


class Best:
    """The k best documents of each item so far, by score and id; documents without an id come last among equals."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.score, self.id, self.null = k, *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool)
        self.floor = np.zeros(items, dtype=np.int64)  # what a score must reach: above 0, or the k-th best

    def take(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        ok = (score > 0) & (score >= self.floor[item])
        if not ok.any():
            return
        item, score, ids, null = (np.concatenate([a, b[ok]]) for a, b in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, item))
        first = np.searchsorted(item[order], item[order])
        place = np.arange(len(order)) - first
        order = order[place < self.k]
        self.item, self.score, self.id, self.null = item[order], score[order], ids[order], null[order]
        full = np.flatnonzero(place == self.k - 1)
        if len(full):
            kept = np.lexsort((ids, null, -score, item))[full]
            self.floor[item[kept]] = score[kept]


def walk(t: Treaps, term: np.ndarray, w: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Takes to `best` what a slice has for the items whose terms (by number, -1: none) and weights are the rows of term
    and w. Returns the number of documents scored."""
    items, width = term.shape
    root = np.array([[t.grow(x) if x >= 0 else -1 for x in row] for row in term.tolist()], dtype=np.int64).reshape(items, width)
    todo = [(np.arange(items), root, np.full(items, -1), np.full(items, t.docs))]
    scored = 0
    while todo:
        item, node, lo, hi = todo.pop()
        worth = np.where(node >= 0, t.impact[node] * w[item], 0)
        bound = worth.sum(axis=1)
        keep = np.flatnonzero((bound > 0) & (bound >= best.floor[item]))
        if len(keep) > max(1, FRONT // width):  # the ranges of highest bounds go first
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            rest = keep[max(1, FRONT // width) :]
            todo.append((item[rest], node[rest], lo[rest], hi[rest]))
            keep = keep[: max(1, FRONT // width)]
        if not len(keep):
            continue
        item, node, lo, hi, worth = item[keep], node[keep], lo[keep], hi[keep], worth[keep]
        pivot = t.doc[node[np.arange(len(keep)), worth.argmax(axis=1)]]
        best.take(item, t.scores(term[item], w[item], pivot), ids[pivot], null[pivot])
        scored += len(keep)
        halves = [(item, t.within(node, lo, pivot), lo, pivot), (item, t.within(node, pivot, hi), pivot, hi)]
        todo.append(tuple(np.concatenate([a, b]) for a, b in zip(*halves, strict=True)))
    return scored


def best_of(asked: pa.Table, slices: pa.Table, n_docs: int, length: int, k: int) -> pa.Table:
    """row, doc_id, score: the best k of a bucket's slices for each item of a group."""
    rows = asked["row"].to_numpy()
    terms, weights = asked["terms"].to_pylist(), asked["weights"].to_pylist()
    best = Best(len(rows), k)
    for at in np.argsort(slices["slice"].to_numpy(), kind="stable").tolist():
        code = {x: i for i, x in enumerate(slices["terms"][at].as_py())}
        if not code:
            continue
        doc, tf = np.frombuffer(slices["postings"][at].as_py(), np.int32).reshape(2, -1)
        ids = slices["ids"][at].values
        null = np.asarray(ids.is_null())
        ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        t = Treaps(slices["n"][at].values.to_numpy(), slices["df"][at].values.to_numpy(), doc, tf, n_docs, length)
        mine = [[(code[x], v) for x, v in zip(a, b, strict=True) if x in code and v > 0] for a, b in zip(terms, weights, strict=True)]
        some = [i for i, m in enumerate(mine) if m]
        some.sort(key=lambda i: len(mine[i]))
        while some:  # items of like numbers of terms together, as rows are padded
            width = len(mine[some[-1]])
            part, some = some[-max(1, FRONT // (64 * width)) :], some[: -max(1, FRONT // (64 * width))]
            term, w = np.full((len(part), width), -1), np.zeros((len(part), width), dtype=np.int64)
            for j, i in enumerate(part):
                term[j, : len(mine[i])], w[j, : len(mine[i])] = zip(*mine[i], strict=True)
            view = Best(len(part), k)
            place = np.full(len(rows), -1)
            place[part] = np.arange(len(part))
            view.floor = best.floor[part]
            walk(t, term, w, ids, null, view)
            best.take(np.array(part, dtype=np.int64)[view.item], view.score, view.id, view.null)
    tidy()
    return pa.table({"row": rows[best.item], "doc_id": pa.array(best.id, mask=best.null), "score": best.score})


def search(slices: DataFrame, terms: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of `slices` (a stored INDEX) for each item of `terms` (see
    item_terms)."""
    spark = slices.sparkSession
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    count, n_docs, length = slices.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(total), F.lit(1))).first()
    pairs = slices.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [times * weight(n_docs, df) for times, df in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(w, pa.int64())], ["row", "item_id", "term", "w"])

    known = terms.join(pairs, "term").select("row", "item_id", "term", "times", "df").mapInArrow(weigh, "row long, item_id long, term binary, w long")
    items = stored(known.groupBy("row", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("p")), "items")
    groups = max(1, -(-items.count() // ITEM_GROUP))
    buckets = max(1, min(count, max(-(-shuffle_partitions(spark) // groups), -(-count // BUCKET_SLICES))))
    grid = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    asked = items.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), grid(buckets).alias("s"), "row", F.col("p.term").alias("terms"), F.col("p.w").alias("weights"))
    held = slices.withColumns({"s": F.pmod(F.xxhash64("slice"), F.lit(buckets)).cast("int"), "g": grid(groups)})

    def run(a: pa.Table, x: pa.Table) -> pa.Table:
        if not a.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("row", "doc_id", "score")})
        return best_of(a, x, n_docs, length, k)

    found = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(run, "row long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return first.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the ten best documents for each benchmark item."""
    terms = item_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), "item_id", "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(stored(index(docs, asked_terms(terms)), "slices"), terms)


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM a JOIN f USING (term) JOIN p USING (term), g GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
