"""What the operators on vectors share: which vectors count, whole-number components, exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(v: Column) -> Column:
    """Whether v is a vector of finite numbers."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(v: Column) -> Column:
    """Components as whole numbers, held in doubles."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def width_of(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(_offsets(c)).max(initial=0)) for c in columns), default=0)


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(_one(column).offsets)


def _one(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(column), width))
    if len(column):
        offsets = _offsets(column)
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = _one(column).flatten().to_numpy(zero_copy_only=False)
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; those beyond 64 bits stand at the ends of that range."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    x, y = ([[int(v) for v in row] for row in m.tolist()] for m in (a, b))
    return np.array([[max(int(LEAST), min(int(MOST), sum(p * q for p, q in zip(r, s, strict=True)))) for s in y] for r in x], dtype=np.int64).reshape(len(a), len(b))
