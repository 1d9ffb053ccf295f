"""Cutting texts into anchored segments for exact search of repeated windows.

Every window of `window` units holds `window - gram + 1` grams; the least of them by hash is the
window's anchor.  Equal windows have equal anchors at equal offsets, wherever they stand.  The
consecutive windows that share one anchor form a segment.  A segment has a key of three numbers: `g`, the
hash of its anchor gram, and 128 bits of a BLAKE2b digest of its very bytes (words joined by one space) and of
where the anchor stands.  So

* a window can only repeat if the `g` of its segment occurs elsewhere,
* all windows of a segment repeat if its key occurs elsewhere,
* only the windows of other segments with a shared `g` have to be compared one by one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from . import hashing as H


@dataclass(frozen=True)
class Spec:
    """kind: 'words' or 'bytes'; window and gram in these units."""

    kind: str
    window: int
    gram: int


WORDS = Spec("words", 35, 12)
BYTES = Spec("bytes", 200, 96)


@dataclass
class Units:
    """Texts of one chunk as one sequence. values: what rolls; bounds: first unit of each text, and the end.

    raw: the texts' bytes, of words those joined by one blank; begin, end: where the units stand in it (of bytes: None)."""

    values: np.ndarray
    second: np.ndarray | None
    bounds: np.ndarray
    raw: bytes
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    def slices(self, spec: Spec):
        """(lo, hi, starts): units lo to hi, and the window starts in it, relative to lo.

        Texts shorter than a window are left out; windows never cross texts.
        """
        size = np.diff(self.bounds)
        todo = np.flatnonzero(size >= spec.window)
        i = 0
        while i < len(todo):
            j, total = i, 0
            while j < len(todo) and (j == i or total + size[todo[j]] <= H.SLICE):
                total += int(size[todo[j]])
                j += 1
            if total <= H.SLICE:
                lo, hi = int(self.bounds[todo[i]]), int(self.bounds[todo[j - 1] + 1])
                ok = np.zeros(hi - lo, dtype=bool)
                for t in todo[i:j]:
                    ok[self.bounds[t] - lo : self.bounds[t + 1] - lo - spec.window + 1] = True
                yield lo, hi, np.flatnonzero(ok)
            else:  # one long text
                lo, end = int(self.bounds[todo[i]]), int(self.bounds[todo[i] + 1])
                for at in range(lo, end - spec.window + 1, H.SLICE):
                    n = min(H.SLICE, end - spec.window + 1 - at)
                    yield at, at + n + spec.window - 1, np.arange(n)
            i = j

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
        """Where in raw the units first..last stand."""
        if self.begin is None:
            return first.tolist(), (last + 1).tolist()
        return self.begin[first].tolist(), self.end[last].tolist()


def units(spec: Spec, texts: list[bytes]) -> Units:
    """texts: UTF-8 bytes."""
    if spec.kind == "bytes":
        raw = b"".join(texts)
        return Units(np.frombuffer(raw, dtype=np.uint8), None, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]), raw)
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    one, two, starts, ends = H.word_hashes(data)
    cuts = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    space = H.SPACE[data]
    keep = ~space  # one blank after each word, whatever stood there
    keep[ends[ends < len(data)]] = True
    place = np.cumsum(keep)
    raw = np.where(space, np.uint8(0x20), data)[keep].tobytes()
    begin = place[starts] - 1 if len(starts) else starts
    return Units(one, two, np.concatenate([[0], np.searchsorted(starts, cuts)]), raw, begin, begin + ends - starts)


def _values(spec: Spec, u: Units, lo: int, hi: int) -> np.ndarray:
    return H.BYTE_VALUES[0][u.values[lo:hi]] if spec.kind == "bytes" else u.values[lo:hi]


@dataclass
class Segments:
    """first, last: window starts (in units of the chunk); g, c, d: the key."""

    first: np.ndarray
    last: np.ndarray
    g: np.ndarray
    c: np.ndarray
    d: np.ndarray


def segments(spec: Spec, u: Units) -> Segments:
    out = []
    for lo, hi, starts in u.slices(spec):
        grams = H.Rolling(_values(spec, u, lo, hi)).fixed(spec.gram)
        anchor = H.sliding_argmin(grams, spec.window - spec.gram + 1)[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (np.diff(anchor) != 0) | (np.diff(starts) != 1)
        at = np.flatnonzero(new)
        first = starts[at]
        last = starts[np.append(at[1:], len(starts)) - 1]
        a = anchor[at]
        # anchors are least hashes, so they are mixed once more to be even over the range
        out.append((first + lo, last + lo, H.mix(grams[a] + np.uint64(1)), a - first))
    if not out:
        e, f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        return Segments(e, e, f, f, f)
    first, last, g, offset = (np.concatenate(x) for x in zip(*out, strict=True))
    lo, hi = u.spans(first, last + spec.window - 1)
    blake, raw = hashlib.blake2b, u.raw
    salts = [i.to_bytes(2, "little") for i in range(spec.window)]
    digests = b"".join([blake(raw[a:b], digest_size=16, salt=salts[o]).digest() for a, b, o in zip(lo, hi, offset.tolist(), strict=True)])
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return Segments(first, last, g, both[:, 0].copy(), both[:, 1].copy())


def window_hashes(spec: Spec, u: Units, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows that begin at the sorted `starts`, as two independent hashes."""
    out = np.empty((2, len(starts)), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + H.SLICE))
        hi = int(starts[j - 1]) + spec.window
        for lane in (0, 1):
            v = H.BYTE_VALUES[lane][u.values[lo:hi]] if spec.kind == "bytes" else (u.values, u.second)[lane][lo:hi]
            out[lane, i:j] = H.run_hashes(v, spec.window, lane)[starts[i:j] - lo]
        i = j
    return out[0], out[1]


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All starts first..last of each segment, in order."""
    n = last - first + 1
    if not len(n):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) - np.repeat(ends - n - first, n)


def covered(n: int, window: int, starts: np.ndarray) -> np.ndarray:
    """Which of n units some window that begins at one of `starts` covers."""
    step = np.bincount(starts, minlength=n + 1).astype(np.int32)[: n + 1]
    step -= np.bincount(starts + window, minlength=n + 1).astype(np.int32)[: n + 1]
    return np.cumsum(step[:n]) > 0
