"""A bounded membership filter over the longs of a frame's column, built by tasks and folded in segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_SEGMENT = 1 << 19
#: Groups of parts in each turn of folding; the last leaves one filter.
FOLDS = (4096, 64, 1)


def spread(values: np.ndarray) -> np.ndarray:
    """Longs as well-mixed unsigned hashes."""
    x = values.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = spread(values), np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set bits, the highest of a byte first."""
    np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))


def has_bits(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return packed[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) > 0


def _partial(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                set_bits(held, at)
        part = TaskContext.get().partitionId()
        for s in range(0, bits // 8, _SEGMENT // 8):
            segment = held[s : s + _SEGMENT // 8]
            if segment.any():
                yield pa.RecordBatch.from_arrays([pa.array([8 * s // _SEGMENT], pa.int64()), pa.array([part], pa.int64()), pa.array([segment.tobytes()], pa.binary())], names=["segment", "part", "held"])

    return run


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    held = np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in pdf["held"]])
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "part": pdf["part"].iloc[:1], "held": [held.tobytes()]})


def membership(values: DataFrame, n: int, *, max_bits: int = 1 << 28) -> Callable[[np.ndarray], np.ndarray]:
    """A function telling which longs may be among the values of the frame's only column: never wrong about those that are,
    seldom about others. Its size is at most ``max_bits`` (32 MB), whatever the number ``n`` of values; a filter that is too
    small for them lets more through."""
    bits = _SEGMENT
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    schema = "segment long, part long, held binary"
    held = values.mapInArrow(_partial(bits), schema)
    for parts in FOLDS:
        held = held.selectExpr("segment", f"pmod(part, {parts}) as part", "held").groupBy("segment", "part").applyInPandas(_fold, schema)
    segments = values.sparkSession.sparkContext.broadcast({r["segment"]: bytes(r["held"]) for r in held.select("segment", "held").collect()})
    unpacked: list[np.ndarray] = []

    def contains(longs: np.ndarray) -> np.ndarray:
        if not unpacked:  # once a task
            packed = np.zeros(bits // 8, np.uint8)
            for s, raw in segments.value.items():
                packed[s * _SEGMENT // 8 : (s + 1) * _SEGMENT // 8] = np.frombuffer(raw, np.uint8)
            unpacked.append(packed)
        a, b = _places(longs, bits)
        return has_bits(unpacked[0], a) & has_bits(unpacked[0], b)

    return contains
