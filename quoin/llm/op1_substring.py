"""Operator 1: substring dedup with a log-structured fingerprint index.

The index keeps, for each anchored segment of word windows, its key (see segments.py: the anchor's hash and 128 bits of a
digest of its words) and whether it was seen once or more often, and the same for 128 bits of each window, so that a new
batch is judged without the texts of earlier ones. Each batch becomes an immutable run, sorted within hash-range buckets;
`fanout` runs of a level are merged into one of the next. `repeats` merge-joins texts with all runs and verifies what only
shares an anchor window by window. Where all texts are judged at once, as in `remove_repeats`, the windows need not be kept,
as the texts are at hand. Memory is bounded by a chunk (2 MB of text, or one text) and by a bucket of keys.

Null texts have no words; texts shorter than a window lose none; texts of any length are taken whole, in slices; an empty
table gives an empty result; repeated rows count as repeats of each other. Only the text column (and what the caller
selects) is read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from . import segments as S
from .shared import CHUNK_BYTES, count_of, discard, fresh, scratch, shuffle_partitions, text_key

RUN = "bucket int, data binary"
WINDOWS = "-windows"
"""Ending of the folder with a run's windows."""
WINDOW_BUCKETS = 8
"""Buckets of windows for each of segments, as about eleven windows are a segment."""
RESULT = "h1 long, h2 long, n_words long, n_removed long, kept_sha256 string, kept string"


class FingerprintIndex:
    """Sorted immutable runs under `path` (in the shared folder unless given). windows: whether the runs keep windows."""

    def __init__(self, spark: SparkSession, path: str | None = None, spec: S.Spec = S.WORDS, buckets: int | None = None, fanout: int = 2, windows: bool = True):
        self.spark, self.spec, self.fanout, self.windows = spark, spec, fanout, windows
        self.path = path or scratch(spark, "fingerprints")
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self._made = 0

    def ingest(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a batch as one run, then compacts what is due."""
        spec, buckets = self.spec, self.buckets
        h1, h2 = text_key(F.col(text))
        source = docs.where(F.col(text).isNotNull()).select(F.lit(0).alias("chunk"), h1.alias("h1"), h2.alias("h2"), F.col(text).cast("string").alias("text"), F.lit(1).cast("long").alias("m"))

        def made(entries):
            def run(batches):
                held, size = [], 0
                for b in batches:
                    held.append(b)
                    size += b.nbytes
                    if size >= CHUNK_BYTES:
                        yield from flush(held)
                        held, size = [], 0
                if held:
                    yield from flush(held)

            def flush(held):
                rows = entries(R.Chunk(spec, pa.Table.from_batches(held)))
                if rows:
                    b, d = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(d, pa.binary())], ["bucket", "data"])

            return source.mapInArrow(run, RUN)

        def fingerprints(c):
            return [(b, R.pack(tuple(k[lo:hi] for k in c.keyed), c.w[lo:hi])) for b, lo, hi in R.ranges(c.keyed[0], buckets)]

        def windows(c):
            starts = S.expand(c.seg.first, c.seg.last)
            of = np.searchsorted(c.units.bounds, starts, side="right") - 1
            keys, w = R.totals(S.window_hashes(spec, c.units, starts), np.minimum(c.m, 2)[of])
            return [(b, R.pack(tuple(k[lo:hi] for k in keys), w[lo:hi])) for b, lo, hi in R.ranges(keys[0], buckets * WINDOW_BUCKETS)]

        self._write(made(fingerprints), made(windows) if self.windows else None, 0)

    def _write(self, parts: DataFrame, windows: DataFrame | None, level: int) -> None:
        def merged(width: int):
            def merge(table: pa.Table) -> pa.Table:
                keys, w, _ = R.unpack(table.column("data").to_pylist(), width)
                return pa.table({"bucket": table.column("bucket").slice(0, 1), "data": pa.array([R.pack(*R.totals(keys, w))], pa.binary())})

            return merge

        self._made += 1
        path = f"{self.path}/level{level}-run{self._made}"
        if windows is not None:
            windows.groupBy("bucket").applyInArrow(merged(2), RUN).write.parquet(path + WINDOWS)
        parts.groupBy("bucket").applyInArrow(merged(3), RUN).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merges all runs of a level into one run of the next level."""
        old, self.levels[level] = self.levels[level], []
        also = [p + WINDOWS for p in old] if self.windows else []
        self._write(self._read(old), self._read(also) if also else None, level + 1)
        for path in old + also:
            discard(self.spark, path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def runs(self, ending: str = "") -> DataFrame:
        return self._read([p + ending for level in self.levels for p in level])

    def repeats(self, docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
        """RESULT for each distinct text of docs (all of which must have been ingested); kept is null unless
        asked for and changed. Windows of other texts count by the index alone; only without windows in the runs
        must docs hold every text that was ingested."""
        spec = self.spec

        def finish(c: R.Chunk, covered: np.ndarray) -> pa.Table:
            rows = []
            for i, t in enumerate(c.texts):
                lo, hi = int(c.units.bounds[i]), int(c.units.bounds[i + 1])
                words, gone = t.split(), covered[lo:hi]
                n = int(gone.sum())
                kept = b" ".join(compress(words, ~gone) if n else words)
                rows.append((int(c.keys[i, 0]), int(c.keys[i, 1]), hi - lo, n, hashlib.sha256(kept).hexdigest(), kept.decode() if n and with_text else None))
            return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["h1", "h2", "n_words", "n_removed", "kept_sha256", "kept"])

        return R.marked(R.chunked(docs, text), spec, finish, RESULT, self.runs(), buckets=self.buckets, windows=self.runs(WINDOWS) if self.windows else None, window_buckets=self.buckets * WINDOW_BUCKETS if self.windows else None)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def indexed(docs: DataFrame, text: str = "text", batches: int = 2, spec: S.Spec = S.WORDS) -> FingerprintIndex:
    """An index of all rows of docs, taken in as `batches` batches, by which to judge all of docs: without windows."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, spec=spec, buckets=max(shuffle_partitions(spark), count_of(docs, text, 512 << 20)), windows=False)
    for i in range(batches):
        index.ingest(docs.where(F.pmod(F.xxhash64(text), F.lit(batches)) == i), text)
    return index


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False, batches: int = 2) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and (if with_text) kept, the text that is left where some was removed.

    A result column that docs already has replaces it."""
    a, b = fresh(docs, "h1", "h2")
    found = indexed(docs, text, batches).repeats(docs, text, with_text)
    new = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    found = found.select(F.col("h1").alias(a), F.col("h2").alias(b), F.struct(*new).alias(fresh(docs, "found")[0]))
    old = [c for c in docs.columns if c.lower() not in new]
    h1, h2 = text_key(F.col(text))
    f = found.columns[2]
    return docs.withColumns({a: h1, b: h2}).join(found, [a, b], "left").select(
        *[F.col(f"`{c}`") for c in old],
        F.coalesce(f"{f}.n_words", F.lit(0).cast("long")).alias("n_words"),
        F.coalesce(f"{f}.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(f"{f}.kept_sha256", F.lit(EMPTY_SHA)).alias("kept_sha256"),
        *([F.col(f"{f}.kept").alias("kept")] if with_text else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row for each document; windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
c AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM p WHERE s IN (SELECT s FROM c)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS s FROM words ANTI JOIN gone USING (r, pos) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
