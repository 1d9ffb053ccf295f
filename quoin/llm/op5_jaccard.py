"""Operator 5: exact n-gram Jaccard join of documents by blocked sparse products.

1. Every text becomes the set of its distinct word shingles, each named by two hashes of 64 bits that mix the words' bytes
   by different constants. Texts with equal sets are one node, named by 126 bits of a BLAKE2b digest of all these names.
   Steps 2 and 3 find proposals and count overlaps by the first hash; a link must hold by both.
2. Chunks of texts learn from buckets of shingles in how many sets each of theirs stands (five bytes are sent for
   each, one returned), and order shingles rare ones first. Two sets with a similarity of at least t share one of the
   first |A| - ceil(t |A|) + 1 shingles of either in any common order, so only these columns of the incidence matrix
   propose links, and of these only the ones with several sets are sent. A column proposes a star, never its pairs;
   what a chunk holds of a column is reduced to one entry before it is sent.
3. Nodes joined by proposals form families, mostly near copies. A family's rows are dealt to tiles of bounded size; a
   task takes two tiles and multiplies their incidence matrices column block by column block. It accumulates overlap
   counts and drops rows once no pair of theirs can reach the overlap that the sizes ask for. It returns a spanning
   forest of the links, not the pairs.
4. Components of these forests, with the smallest doc_id of each.

Null or empty texts and texts without words have an empty set and link with nothing; rows without doc_id have
component null and link with nothing; repeated rows fall together; rows that share a doc_id but not their text are judged
each by its own text. Long texts are hashed in slices of about a megabyte of text (or one text) and never cut. Only doc_id
and text are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .components import components
from .op8_embeddings import Forest
from .repeats import BLOBS, blobs, chunked, in_order, ranges, starts_of, texts_of
from .shared import CHUNK_BYTES, count_of, shuffle_partitions, stored, text_key

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
TILE = 1 << 19
"""Shingles in a tile."""
COLUMNS = 8
"""Column blocks of a product."""
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Join:
    """shingle: words in a shingle; percent: the least similarity in hundredths."""

    shingle: int = 4
    percent: int = 85

    def need(self, size: np.ndarray) -> np.ndarray:
        """Least overlap of a set of `size` with anything similar."""
        return (self.percent * size + 99) // 100


Names = tuple[np.ndarray, np.ndarray]
"""Two hashes of each shingle."""


def shingles(texts: list[bytes], k: int) -> tuple[Names, np.ndarray]:
    """Names of the distinct shingles of each text, in order within it; bounds of the texts."""
    out: list[Names] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= H.SLICE * 4):
            size += len(texts[j]) + 1
            j += 1
        *lanes, starts, _ = H.word_hashes(LOWER[np.frombuffer(b" ".join(texts[i:j]), dtype=np.uint8)])
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]], dtype=np.int64)
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            width = min(k, b - a)
            if not width:
                out.append((np.empty(0, np.uint64), np.empty(0, np.uint64)))
                continue
            names = []
            for words, m in zip(lanes, MULTIPLIERS, strict=True):
                h = np.full(b - a - width + 1, width, dtype=np.uint64)
                for n in range(width):
                    h = H.mix(h * m + words[a + n : a + n + len(h)])
                names.append(h)
            order = in_order(tuple(names))
            new = starts_of(tuple(names), order)
            out.append((names[0][order][new], names[1][order][new]))
        i = j
    bounds = np.concatenate([[0], np.cumsum([len(x) for x, _ in out], dtype=np.int64)])
    return tuple(np.concatenate([x[lane] for x in out]) if out else np.empty(0, np.uint64) for lane in (0, 1)), bounds


NODE = pa.decimal128(38, 0)
"""A node is a whole number below 2**126: of this type Spark aggregates in hash tables, as it does with longs."""


def nodes(h: Names, bounds: np.ndarray) -> np.ndarray:
    """The name of each set, as two columns of 64 bits; the same for equal sets."""
    cuts = bounds.tolist()
    out = b"".join([hashlib.blake2b(h[0][a:b].tobytes() + h[1][a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    out = np.frombuffer(out, "<u8").reshape(-1, 2).copy()
    out[:, 1] >>= np.uint64(2)
    return out


def to_column(names: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(NODE, len(names), [None, pa.py_buffer(np.ascontiguousarray(names))])


def from_column(column: pa.ChunkedArray) -> np.ndarray:
    if not len(column):
        return np.empty((0, 2), np.uint64)
    parts = [np.frombuffer(c.buffers()[1], "<u8")[2 * c.offset : 2 * (c.offset + len(c))] for c in column.chunks if len(c)]
    return np.concatenate(parts).reshape(-1, 2)


def coded(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names as places in the ordered distinct names, and these."""
    keys = (names[:, 0], names[:, 1])
    order = in_order(keys)
    new = starts_of(keys, order)
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return code, names[order][new]


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Batches gathered to about a chunk of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            t = pa.Table.from_batches(held)
            yield t, t.column(column).cast(pa.binary()).to_pylist()
            held, size = [], 0
    if held:
        t = pa.Table.from_batches(held)
        yield t, t.column(column).cast(pa.binary()).to_pylist()


def degrees(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order, how many sets of the chunk hold each (255 at most), and which one each of h is."""
    u, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return u, np.minimum(n, 255).astype(np.uint8), back


def ranked(ask: list[bytes]) -> list[bytes]:
    """For each shingle asked about: 0 if one set of the corpus holds it, else four times the log of their number.

    Of a shingle, a bucket sees the lower half of its hash; a collision can only make it look more frequent."""
    sizes = [len(d) // 5 for d in ask]
    low = np.concatenate([np.frombuffer(d, np.uint32, n) for d, n in zip(ask, sizes, strict=True)])
    w = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for d, n in zip(ask, sizes, strict=True)])
    _, back = np.unique(low, return_inverse=True)
    rank = np.clip(np.ceil(4 * np.log2(np.bincount(back, weights=w))), 0, 255).astype(np.uint8)[back]
    return [rank[e - n : e].tobytes() for n, e in zip(sizes, np.cumsum(sizes, dtype=np.int64), strict=True)]


def prefixes(h: np.ndarray, bounds: np.ndarray, rank: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set that propose links, rare ones first, without those of one set; and which set each is of."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, rank, of))
    at = np.arange(len(h)) - bounds[of]
    size = np.diff(bounds)
    keep = (at < (size - join.need(size) + 1)[of]) & (rank[order] > 0)
    return h[order][keep], of[keep]


def stars(keys: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least node; and edges from that node to the key's others."""
    order = np.lexsort((node, keys))
    k, n = keys[order], node[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    least = n[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else n
    far = least != n
    edges = np.unique(np.stack([least[far], n[far]], axis=1), axis=0) if far.any() else np.empty((0, 2), np.int64)
    return k[new], n[new], edges[:, 0], edges[:, 1]


EDGES = "a decimal(38,0), b decimal(38,0)"


class Sets:
    """The distinct sets of a chunk of texts (see repeats.chunked)."""

    def __init__(self, table: pa.Table, join: Join):
        _, texts, _ = texts_of(table)
        h, bounds = shingles(texts, join.shingle)
        code, self.node = coded(nodes(h, bounds))
        _, first = np.unique(code, return_index=True)
        self.h, self.h2 = (np.concatenate([x[bounds[i] : bounds[i + 1]] for i in first]) if len(first) else x for x in h)
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[first], dtype=np.int64)])


def proposals(texts: DataFrame, join: Join, buckets: int) -> DataFrame:
    """(a, b): nodes that share a proposing column, as stars."""
    local = -1
    held = texts.groupBy("chunk")

    def ask(table: pa.Table) -> pa.Table:
        x, number = Sets(table, join), table["chunk"][0].as_py()
        u, n, _ = degrees(x.h, x.bounds)
        return blobs([(number, b, 0, (u[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + n[lo:hi].tobytes()) for b, lo, hi in ranges(u, buckets)])

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("chunk", "bucket", "data")), strict=True))
        return blobs([(c, b, 0, d) for (c, b, _), d in zip(rows, ranked([r[2] for r in rows]), strict=True)])

    def propose(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blobs([])
        x, number = Sets(table, join), table["chunk"][0].as_py()
        _, _, back = degrees(x.h, x.bounds)
        rank = np.frombuffer(b"".join(d for _, d in sorted(zip(replies["bucket"].to_pylist(), replies["data"].to_pylist(), strict=True))), np.uint8)
        keys, of = prefixes(x.h, x.bounds, rank[back] if len(back) else rank, join)
        k, n, a, b = stars(keys, of)  # a chunk's sets are in the order of their names
        rows = [(number, bucket, 1, k[lo:hi].tobytes() + x.node[n[lo:hi]].tobytes()) for bucket, lo, hi in ranges(k, buckets)]
        return blobs(rows + [(number, local - number, 1, x.node[a].tobytes() + x.node[b].tobytes())] * bool(len(a)))

    def meet(table: pa.Table) -> pa.Table:
        data = table["data"].to_pylist()
        if table["bucket"][0].as_py() <= local:
            both = [np.frombuffer(d, np.uint64).reshape(2, -1, 2) for d in data]
            a, b = (np.concatenate([x[i] for x in both]) for i in (0, 1))
        else:
            n = [len(d) // 24 for d in data]
            keys = np.concatenate([np.frombuffer(d, np.uint64, m) for d, m in zip(data, n, strict=True)])
            code, names = coded(np.concatenate([np.frombuffer(d, np.uint64, 2 * m, 8 * m) for d, m in zip(data, n, strict=True)]).reshape(-1, 2))
            a, b = (names[i] for i in stars(keys, code)[2:])
        return pa.table({"a": to_column(a), "b": to_column(b)})

    replies = held.applyInArrow(ask, BLOBS).groupBy("bucket").applyInArrow(answer, BLOBS)
    return held.cogroup(replies.groupBy("chunk")).applyInArrow(propose, BLOBS).groupBy("bucket").applyInArrow(meet, EDGES)


def overlap(a: Names, b: Names) -> int:
    """Shingles that two sets share, by both hashes."""
    keys = tuple(np.concatenate(x) for x in zip(a, b, strict=True))
    return len(keys[0]) - int(starts_of(keys, in_order(keys)).sum())


def product(a: tuple[Names, np.ndarray], b: tuple[Names, np.ndarray], same: bool, join: Join) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the similar pairs of two tiles; rows of the second are numbered after the first."""
    (ha, ha2), ba = a
    (hb, hb2), bb = b
    na, nb = np.diff(ba), np.diff(bb)
    rows_a, rows_b = np.arange(len(na)), np.arange(len(nb))
    of_a, of_b = np.repeat(rows_a, na), np.repeat(rows_b, nb)
    block_a, block_b = (ha >> np.uint64(61)).astype(np.int64), (hb >> np.uint64(61)).astype(np.int64)
    rest_a = np.bincount(of_a * COLUMNS + block_a, minlength=len(na) * COLUMNS).reshape(-1, COLUMNS)
    rest_b = np.bincount(of_b * COLUMNS + block_b, minlength=len(nb) * COLUMNS).reshape(-1, COLUMNS)
    rest_a, rest_b = rest_a[:, ::-1].cumsum(axis=1)[:, ::-1], rest_b[:, ::-1].cumsum(axis=1)[:, ::-1]
    forest = Forest(len(na) + (0 if same else len(nb)))
    shift = 0 if same else len(na)
    order_b = np.lexsort((of_b, hb))
    cols, begin = np.unique(hb[order_b], return_index=True)
    end = np.append(begin[1:], len(hb))
    posting = of_b[order_b]
    for i in rows_a:
        p = join.percent
        need = (p * (na[i] + nb) + 99 + p) // (100 + p)
        alive = (need <= np.minimum(na[i], nb)) & (100 * np.minimum(na[i], nb) >= p * np.maximum(na[i], nb))
        if same:
            alive[: i + 1] = False
        if not alive.any():
            continue
        mine = ha[ba[i] : ba[i + 1]]
        cut_at = np.searchsorted(mine, np.arange(1, COLUMNS, dtype=np.uint64) << np.uint64(61))
        count = np.zeros(len(nb), dtype=np.int64)
        for c, block in enumerate(np.split(mine, cut_at)):
            at = np.searchsorted(cols, block)
            at = at[(at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == block)] if len(cols) else at[:0]
            if len(at):
                n = end[at] - begin[at]
                e = np.cumsum(n)
                count += np.bincount(posting[np.arange(e[-1]) - np.repeat(e - n - begin[at], n)], minlength=len(nb))
            if c + 1 < COLUMNS:
                alive &= count + np.minimum(rest_a[i, c + 1], rest_b[:, c + 1]) >= need
                if not alive.any():
                    break
        for j in np.flatnonzero(alive & (100 * count >= p * (na[i] + nb - count))).tolist():
            if forest.find(int(i)) != forest.find(j + shift):
                n = overlap((mine, ha2[ba[i] : ba[i + 1]]), (hb[bb[j] : bb[j + 1]], hb2[bb[j] : bb[j + 1]]))
                if 100 * n >= p * (na[i] + nb[j] - n):
                    forest.join(int(i), j + shift)
    return forest.edges


def joined(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text", with_text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; with_text_key: and the name of its group of sets (null: no set), and
    the text's key h1, h2 (see shared.text_key)."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    spark = docs.sparkSession

    chunks = count_of(docs, "text", CHUNK_BYTES, shuffle_partitions(spark))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _grouped(batches, 1):
            h, bounds = shingles([t or b"" for t in texts], join.shingle)
            yield from pa.table({"doc_id": table["doc_id"], "n": np.diff(bounds), "node": to_column(nodes(h, bounds)), "chunk": table["chunk"], "h1": table["h1"], "h2": table["h2"]}).to_batches()

    h1, h2 = text_key(F.col("text"))
    place = F.pmod(h1, F.lit(chunks)).cast("int").alias("chunk")
    sets = stored(docs.select("doc_id", "text", place, h1.alias("h1"), h2.alias("h2")).mapInArrow(name, "doc_id long, n long, node decimal(38,0), chunk int, h1 long, h2 long"), "shingle-sets")
    buckets = max(shuffle_partitions(spark), chunks * CHUNK_BYTES >> 28)
    texts = chunked(docs.where(F.col("doc_id").isNotNull()), "text", chunks)
    family = components(proposals(texts, join, buckets), "a", "b")
    member = family.select("node", "root").union(family.select("root", "root").distinct()).toDF("node", "family")
    shown = sets.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("chunk").alias("chunk")).join(member, "node")
    shown = stored(shown, "members")
    width = shown.groupBy("family").agg(F.sum("n").alias("total")).select("family", F.ceil(F.col("total") / TILE).alias("tiles"))
    packs = max(shuffle_partitions(spark), chunks // 8)
    placed = shown.join(width, "family").select("chunk", "node", "family", "tiles", F.pmod(F.xxhash64("node"), "tiles").alias("tile"))

    def send(table: pa.Table, members: pa.Table) -> pa.Table:
        if not table.num_rows or not members.num_rows:
            return members.select(["node", "family", "tiles", "tile"]).slice(0, 0).append_column("data", pa.array([], pa.binary()))
        x = Sets(table, join)
        both, _ = coded(np.concatenate([x.node, from_column(members["node"])]))  # members are sets of this chunk
        at = both[len(x.node) :]
        data = [x.h[x.bounds[i] : x.bounds[i + 1]].tobytes() + x.h2[x.bounds[i] : x.bounds[i + 1]].tobytes() for i in at]
        return members.select(["node", "family", "tiles", "tile"]).append_column("data", pa.array(data, pa.binary()))

    rows = texts.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(send, "node decimal(38,0), family decimal(38,0), tiles long, tile long, data binary")
    # tile t meets the tiles before it as the second, those after it as the first, and itself once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    rows = rows.withColumn("task", F.when(F.col("tiles") == 1, F.concat_ws("/", F.lit("pack"), F.pmod(F.xxhash64("family"), F.lit(packs)).cast("string"))).otherwise(F.concat_ws("/", *[F.col(c).cast("string") for c in ("family", "lo", "hi")])))

    def multiply(table: pa.Table) -> pa.Table:
        (family, _), (node, names) = (coded(from_column(table[c])) for c in ("family", "node"))
        tile = table["tile"].to_numpy()
        lo, hi, data = table["lo"].to_numpy(), table["hi"].to_numpy(), table["data"].to_pylist()
        order = np.lexsort((node, tile, family))
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            at = at[np.r_[True, np.diff(node[at]) != 0]] if len(at) else at  # a node may come from two map tasks
            same = lo[at[0]] == hi[at[0]]
            a, b = at[tile[at] == lo[at[0]]], at[tile[at] == hi[at[0]]]
            if not len(a) or not len(b):
                continue
            held = []
            for side in (a, b):
                x = [np.frombuffer(data[i], np.uint64).reshape(2, -1) for i in side]
                held.append((tuple(np.concatenate([v[lane] for v in x]) for lane in (0, 1)), np.concatenate([[0], np.cumsum([v.shape[1] for v in x])])))
            every = node[a] if same else np.r_[node[a], node[b]]
            out += [(every[i], every[j]) for i, j in product(*held, same, join)]
        x = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": to_column(names[x[:, 0]]), "b": to_column(names[x[:, 1]])})

    links = rows.select("task", "family", "node", "tile", "lo", "hi", "data").groupBy("task").applyInArrow(multiply, EDGES)
    roots = components(links, "a", "b")
    rooted = sets.join(roots, "node", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = rooted.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), *([F.col("c").alias("group"), "h1", "h2"] if with_text_key else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: four-word shingles, similarity of 0.85 or more."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
k AS MATERIALIZED (SELECT g, min(r) AS k, len(g) AS n FROM s WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY g),
e AS MATERIALIZED (SELECT k, n, unnest(g) AS x FROM k),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(node, root) AS (SELECT k, k FROM k UNION SELECT l.b, c.root FROM c JOIN l ON c.node = l.a WHERE c.root < l.b),
f AS (SELECT node, min(root) AS root FROM c GROUP BY node),
m AS (SELECT s.r, f.root FROM s JOIN k ON s.g = k.g JOIN f ON f.node = k.k),
t AS (SELECT root, min(doc_id) AS least FROM m JOIN s USING (r) WHERE doc_id IS NOT NULL GROUP BY root)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN coalesce(t.least, s.doc_id) END AS component_id
FROM s LEFT JOIN m USING (r) LEFT JOIN t USING (root)
"""
