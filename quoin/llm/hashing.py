"""Vectorised hashes over byte and word sequences (numpy).

Words are named by two lanes of 64 bits that mix their bytes block by block, without linear structure; longer words by a
BLAKE2b digest. Rolling sums mod 2**64 only choose anchors, never decide equality. Everything is a pure function of its
input and of fixed seeds, so a task that is run again after an executor is lost gives the same values.
"""

from __future__ import annotations

import hashlib

import numpy as np

SLICE = 1 << 18
"""Units that one pass holds in memory; longer texts are walked in slices."""

_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


def _table(seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, np.iinfo(np.uint64).max, 256, dtype=np.uint64, endpoint=True)


BYTE_VALUES = (_table(20_231), _table(77_003))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept per worker and grown by doubling."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any run of `units` in O(1) after one cumulative sum."""

    def __init__(self, units: np.ndarray, which: int = 0):
        n = len(units)
        pw, self.inv = powers(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * pw[:n], dtype=np.uint64, out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Hash of every run of `length` units, by start."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of units[lo:hi] for arrays of bounds."""
        return mix((self.sums[hi] - self.sums[lo]) * self.inv[lo])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


SHORT = 64
"""Bytes of a word that are mixed; of a longer one a digest is taken."""
_LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)))
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, and the words' starts and ends."""
    starts, ends = word_bounds(data)
    size = ends - starts
    lanes = [mix(size.astype(np.uint64) * m + a) for m, a in _LANES]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    todo = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        block = blocks[starts[todo] + at] & _KEEP[np.minimum(size[todo] - at, 8)]
        for lane, (m, a) in zip(lanes, _LANES, strict=True):
            lane[todo] = mix((lane[todo] ^ block) * m + a)
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        lanes[0][i], lanes[1][i] = np.frombuffer(digest, "<u8")
    return lanes[0], lanes[1], starts, ends


def run_hashes(units: np.ndarray, length: int, lane: int) -> np.ndarray:
    """Hash of every run of `length` units, by start: hashes of runs of 1, 2, 4 .. units are mixed pairwise."""
    if len(units) < length:
        return np.empty(0, dtype=np.uint64)
    m, a = _LANES[lane]
    whole, done, part, size = None, 0, units, 1
    while True:
        if length & size:  # this power of two is part of the length
            whole = part if whole is None else mix((whole[: len(part) - done] * m + a) ^ part[done:])
            done += size
        if done == length:
            return whole[: len(units) - length + 1]
        part = mix((part[:-size] * m + a) ^ part[size:])
        size *= 2


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of each `width` consecutive values.

    Values are compared by their upper 40 bits, ties by position, so the choice depends on
    nothing but what the window holds.
    """
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.int64)
    keys = (values & ~_POS_MASK) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & _POS_MASK).astype(np.int64)
