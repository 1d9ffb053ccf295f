"""Operator 10: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is a row of symbols. An agenda holds the adjacent pairs whose union is a piece, best score first and
leftmost among equals; the best pair is merged and its new neighbours join the agenda, until none is left.
Where no piece has a space mark after another character, merges never cross the places where a run of space
marks begins, nor any two adjacent characters that no piece has together, so each such section is solved once and
kept in a bounded cache. Words of a batch that the cache lacks are solved in step: each round takes the head of every
word's agenda at once, as arrays. Every Arrow batch is also encoded
by the sentencepiece library: `agreed` tells whether it has the same ids. The ids that are returned are the agenda's own.
Ids of sections and texts are kept packed, as 32-bit integers in bytes: a text's are those of its words joined.
Texts that a task has met before (by 128 bits of their digest) get the row they had.

Null and empty texts give the end id alone; long texts are encoded whole; repeated rows get equal ids; an empty table gives
an empty result. Other columns, whatever their names, play no part; those to `keep` must not have a result's name.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

SPACE = "▁"
CACHE = 2_000_000
"""Sections kept by a worker, in two halves: a full half becomes the older one, and the oldest goes.
Two million take some 500 MB."""
KNOWN = 50_000
"""Results of texts kept by a task; then it starts anew. They take some 20 MB."""
SHORT = 40
LOT = 20_000
"""Words solved in step."""
FEW = 200
"""Fewer words are solved one by one."""
NEVER = float("inf")


def pack(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, np.int32).tolist()


def listed(packed: Sequence[bytes]) -> pa.ListArray:
    """A column of lists from the packed ids of each row."""
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(packed), np.int32))


class Agenda:
    """Encoder over a vocabulary: pieces with scores, byte pieces, an unknown id and an end id."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, end: int, prefix: bool = True, cache: int = CACHE):
        self.pieces, self.byte_ids, self.unknown, self.end, self.prefix, self.limit = pieces, byte_ids, unknown, end, prefix, cache
        self.sectioned = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.score = {p: -s for p, (_, s) in pieces.items()}.get
        self.bigrams = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.lone: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, processor, cache: int = CACHE) -> Agenda:
        """From a loaded sentencepiece model without user-defined pieces or unused ids."""
        n = processor.get_piece_size()
        special = [i for i in range(n) if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i)]
        skip = set(special)
        pieces = {processor.id_to_piece(i): (i, processor.get_score(i)) for i in range(n) if i not in skip}
        hexes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, hexes if all(processor.is_byte(i) for i in hexes) else None, processor.unk_id(), processor.eos_id(), cache=cache)

    def merge(self, section: str) -> tuple[int, ...]:
        """The ids of one section: a short one's agenda is a list by position, a long one's a heap."""
        return self.ids_of(self.merged_short(section) if len(section) <= SHORT else self.merged_long(section))

    def merged_short(self, section: str) -> list[str]:
        score = self.score
        symbols = list(section)
        agenda = [score(section[i : i + 2], NEVER) for i in range(len(section) - 1)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost of the best
            del agenda[i]
            symbols[i] = union = symbols[i] + symbols.pop(i + 1)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + union, NEVER)
            if i < len(agenda):
                agenda[i] = score(union + symbols[i + 1], NEVER)
        return symbols

    def merged_long(self, section: str) -> list[str]:
        score, push, pop = self.score, heapq.heappush, heapq.heappop
        symbols: list[str] = list(section)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(found, i, i + 1, 2) for i in range(n - 1) if (found := score(section[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = pop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two has been merged with another since
            symbols[left] = a = a + b
            symbols[right] = ""
            after[left] = next_ = after[right]
            if next_ >= 0:
                before[next_] = left
                union = a + symbols[next_]
                if (found := score(union)) is not None:
                    push(agenda, (found, left, next_, len(union)))
            if (last := before[left]) >= 0:
                union = symbols[last] + a
                if (found := score(union)) is not None:
                    push(agenda, (found, last, left, len(union)))
        return [s for s in symbols if s]

    def ids_of(self, symbols: list[str]) -> tuple[int, ...]:
        pieces = self.pieces
        try:
            return tuple([pieces[s][0] for s in symbols])
        except KeyError:  # a character that no piece has
            ids: list[int] = []
            for s in symbols:
                if (found := pieces.get(s)) is not None:
                    ids.append(found[0])
                elif self.byte_ids is None:
                    ids.append(self.unknown)
                else:
                    ids.extend(self.byte_ids[b] for b in s.encode())
            return tuple(ids)

    def words(self, text: str) -> list[str] | None:
        """The words of a text whose sections are a space mark and a word each."""
        if text and self.sectioned and self.prefix and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return None

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, the end id last."""
        return list(map(unpack, self.packed_all(texts)))

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, the end id last; words that the cache lacks are solved together."""
        split = [self.words(t) for t in texts]
        found = [w and list(map(self.kept.get, w)) for w in split]
        holes = [f and [i for i, ids in enumerate(f) if ids is None] for f in found]
        solved = self.solve_all({w[i] for w, h in zip(split, holes, strict=True) if h for i in h})
        end = pack([self.end])
        out = []
        for text, w, f, h in zip(texts, split, found, holes, strict=True):
            if w:
                for i in h:
                    f[i] = solved[w[i]]
                f.append(end)
                out.append(b"".join(f))
            else:
                out.append(self.marked(text) + end)
        return out

    def marked(self, text: str) -> bytes:
        """Packed ids of a text of any form, section by section."""
        marked = (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)
        if not self.sectioned:
            return pack(self.merge(marked))
        sections = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
        return b"".join([self.kept.get(s[1:]) or self.recall(s[1:]) if s[0] == SPACE else pack(self.merge(s)) for s in sections])

    def recall(self, word: str) -> bytes:
        """Packed ids of a section (a space mark and a word): from the older half of the cache, else solved."""
        if (ids := self.older.get(word)) is None:
            ids = self.solve(SPACE + word)
        if len(word) < 100:
            if len(self.kept) >= self.limit // 2:
                self.older, self.kept = self.kept, {}
            self.kept[word] = ids
        return ids

    def solve_all(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of sections as by `recall`: short ones in step, if there are enough."""
        solved = {w: ids for w in words if (ids := self.older.get(w)) is not None}
        new = [w for w in words if w not in solved and len(w) < SHORT]
        if len(new) >= FEW and self.tables:
            for at in range(0, len(new), LOT):
                solved.update(self.packed_in_step(new[at : at + LOT]))
        if len(self.kept) + len(solved) > self.limit // 2:
            self.older, self.kept = self.kept, {}
        self.kept.update(islice(solved.items(), self.limit // 2))
        for w in words:
            if w not in solved:
                solved[w] = self.recall(w)
        return solved

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Sequence[int] | None]] | None:
        """(symbol of each character, keys of the pairs that form a piece, their unions, id of each symbol, ids of each that
        has no own one). Symbols are numbered by falling score, so the head of an agenda is its least union; pieces of several
        space marks are in no word. The last symbol stands for all characters that no piece has. None where unions share a
        score."""
        order = sorted((p for p in self.pieces if p.count(SPACE) < 2), key=self.score)
        if len({self.score(p) for p in order if len(p) > 1}) < sum(len(p) > 1 for p in order):
            return None
        names = order + sorted({c for p in order for c in p} - self.pieces.keys())
        at = {s: i for i, s in enumerate(names)}
        pairs = sorted((at[p[:i]] * (len(names) + 1) + at[p[i:]], at[p]) for p in order for i in range(1, len(p)) if p[:i] in at and p[i:] in at)
        chars = np.full(max(map(ord, (s for s in names if len(s) == 1)), default=0) + 2, len(names), np.int32)
        for s in names:
            if len(s) == 1:
                chars[ord(s)] = at[s]
        keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        unions = np.array([u for _, u in pairs] + [0], np.int32)
        ids = np.array([self.pieces[s][0] if s in self.pieces else -1 for s in names] + [-1], np.int32)
        spelt = [None if s in self.pieces else self.ids_of([s]) for s in names] + [None]
        return chars, keys, unions, ids, spelt

    def spelled(self, word: str, row: list[int]) -> list[int]:
        """Ids of a word's symbols if not all of them have one."""
        chars, _, _, ids, spelt = self.tables
        foreign = (c for c in word if ord(c) >= len(chars) or chars[ord(c)] == len(ids) - 1)
        out: list[int] = []
        for symbol in row:
            if ids[symbol] >= 0:
                out.append(int(ids[symbol]))
            elif symbol < len(ids) - 1:
                out += spelt[symbol]
            else:
                out += self.ids_of([next(foreign)])
        return out

    def merged_in_step(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Words and their ids."""
        return ((w, tuple(unpack(ids))) for w, ids in self.packed_in_step(words))

    def packed_in_step(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words and their packed ids. Every round merges one pair of each word that has one left, so words still open have
        one length; shorter ones join as that length is reached."""
        chars, keys, unions, ids, _ = self.tables
        none = np.iinfo(np.int32).max

        def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a.astype(np.int64) * len(ids) + b
            found = np.searchsorted(keys, key)
            return np.where(keys[found] == key, unions[found], none)

        def without(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
            stays = np.ones(grid.shape, bool)
            stays[np.arange(len(at)), at] = False
            return grid[stays].reshape(len(at), grid.shape[1] - 1)

        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(length.max())
        points = np.array([SPACE + w for w in words], f"U{width}").view(np.uint32).reshape(-1, width)
        grid = chars[np.minimum(points, len(chars) - 1)]
        who, symbols, agenda = np.empty(0, np.int64), np.empty((0, width), np.int32), np.empty((0, width), np.int32)
        for w in range(width, 0, -1):  # the agenda's last column, without a pair, is always `none`
            joins = np.flatnonzero(length == w)
            fresh = grid[joins, :w]
            pairs = np.full(fresh.shape, none, np.int32)
            pairs[:, :-1] = union(fresh[:, :-1], fresh[:, 1:])
            who, symbols, agenda = np.concatenate([who, joins]), np.concatenate([symbols, fresh]), np.concatenate([agenda, pairs])
            at = agenda.argmin(1)  # the leftmost of the best
            best = agenda[np.arange(len(who)), at]
            on = best != none
            done, ready = symbols[~on], [words[i] for i in who[~on].tolist()]
            own = ids[done]
            whole, size = own.tobytes(), 4 * w
            rows = [whole[i : i + size] for i in range(0, len(whole), size)]
            for i in np.flatnonzero((own < 0).any(1)).tolist():
                rows[i] = pack(self.spelled(ready[i], done[i].tolist()))
            yield from zip(ready, rows, strict=True)
            who, at, best = who[on], at[on], best[on]
            symbols, agenda = without(symbols[on], at + 1), without(agenda[on], at)
            row = np.arange(len(who))
            symbols[row, at] = best
            if (r := row[at > 0]).size:
                agenda[r, at[r] - 1] = union(symbols[r, at[r] - 1], best[r])
            if (r := row[at < w - 2]).size:
                agenda[r, at[r]] = union(best[r], symbols[r, at[r] + 1])

    def solve(self, section: str) -> bytes:
        """A section falls apart where no piece has its two adjacent characters."""
        if section[1:].isascii() and section[1:].isalpha():  # rarely does
            return pack(self.merge(section))
        ids: list[bytes] = []
        at, bigrams, lone = 0, self.bigrams, self.lone
        for i in range(1, len(section) + 1):
            if i == len(section) or section[i - 1 : i + 1] not in bigrams:
                part = section[at:i]
                if len(part) == len(section):
                    return pack(self.merge(section))
                if len(part) == 1:
                    if part not in lone:
                        lone[part] = pack(self.ids_of([part]))
                    ids.append(lone[part])
                elif part[0] == SPACE:
                    ids.append(self.kept.get(part[1:]) or self.recall(part[1:]))
                else:
                    ids.append(pack(self.merge(part)))
                at = i
        return b"".join(ids)


_loaded: dict[tuple[str, int], tuple] = {}


def loaded(model: str, cache: int = CACHE) -> tuple:
    """(library's processor, our encoder, ids as text) of a model file, once for each worker."""
    if (model, cache) not in _loaded:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        _loaded[model, cache] = (p, Agenda.of(p, cache), np.array([str(i) for i in range(p.get_piece_size())], object))
    return _loaded[model, cache]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """`keep` columns, SCHEMA, and with with_ids the ids. model: a path that workers can open,
    as that of an installed package's file."""
    from pyspark.sql.types import StructField, StructType

    safe = [f"keep_{i}" for i in range(len(keep))]  # names that mapInArrow can resolve
    out = StructType([StructField(k, docs.schema[c].dataType) for c, k in zip(keep, safe, strict=True)] + StructType.fromDDL(SCHEMA).fields + (StructType.fromDDL("ids array<int>").fields if with_ids else []))

    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def sha(t: str) -> str:
        return hashlib.sha256(t.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, agenda, names = loaded(model, cache)
        known: dict[bytes, tuple] = {}
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and passes over the cache take time
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 96):
                    b = whole.slice(at, 96)
                    texts = [t or "" for t in b.column(len(keep)).to_pylist()]
                    digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                    if len(known) > KNOWN:
                        known.clear()
                    found = {} if with_ids else known  # ids are long: kept for one slice only
                    new = {d: t for d, t in zip(digests, texts, strict=True) if d not in found}
                    for (d, t), packed in zip(new.items(), agenda.packed_all(list(new.values())), strict=True):
                        ids = np.frombuffer(packed, np.int32)
                        agreed = packed == library.encode(t, add_eos=True, return_type="numpy").tobytes()
                        row = len(ids), sha(" ".join(names[ids].tolist())), sha(library.decode(ids)), agreed
                        found[d] = (*row, packed) if with_ids else row
                    values = list(zip(*(found[d] for d in digests), strict=True))
                    cols = [pa.array(x, t) for x, t in zip(values[: len(kinds)], kinds, strict=True)]
                    cols += map(listed, values[len(kinds) :])  # the ids, if asked for
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=out.names)
        finally:
            if collects:
                gc.enable()
        tidy()

    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, safe, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    return source.mapInArrow(run, out).toDF(*keep, *out.names[len(keep) :])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with the 32k piece vocabulary."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_model())
