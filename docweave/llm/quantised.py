"""Vectors turned into whole numbers, for operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores and squared distances of two vectors must stay below this, so that they and small sums of them fit a long.
_LIMIT = 1 << 62


def quantised(lists: pa.Array, scale: float, spread: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column count, the lengths of those, and their components ``floor(scale * x)`` one after the other.

    A row counts if it is not null and has no null or non-finite component. The products of two rows must fit a long: rows of d
    components of which one is ``sqrt(2**62 / d) / spread`` or more in size don't count either."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    finite = np.isfinite(values)
    size = np.where(finite, np.abs(values), np.inf)
    starts = np.cumsum(lengths) - lengths
    largest = np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        largest[some] = np.maximum.reduceat(size, starts[some])
    counts = lists.is_valid().to_numpy(zero_copy_only=False) & (largest < np.sqrt(_LIMIT / np.maximum(lengths, 1)) / spread)
    ints = np.where(finite, values, 0.0)[np.repeat(counts, lengths)].astype(np.int32)
    return np.flatnonzero(counts), lengths[counts], ints


def packed(ints: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of 32-bit components as a binary column, little-endian."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * 4
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ints.astype("<i4", copy=False))])


def matrix(vectors: pa.Array | list[bytes], dims: int) -> np.ndarray:
    """Packed vectors of one length as a matrix of 32-bit integers."""
    rows = vectors.to_pylist() if isinstance(vectors, (pa.Array, pa.ChunkedArray)) else vectors
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``: in float64 while no sum can reach 2**53, else in integers."""
    bound = a.shape[1] * float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(b, dtype=np.float64).max(initial=0))
    kind = np.float64 if bound < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T
