"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin (and the last's end).

    A-Z are lower-cased; words are parted by ASCII white space. A text with fewer words than ``width`` has its whole sequence
    as one shingle; without words it has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h, owner = table[coded.indices.to_numpy()[real]], owner[real]
    n = np.bincount(owner, minlength=len(texts))
    start = np.cumsum(n) - n
    if len(h) >= width:
        acc = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            acc = mix(acc * _ODD[i] + h[i : len(h) - width + 1 + i] + _ODD[-1 - i])
        inside = owner[: len(acc)] == owner[width - 1 :]
        acc, own = acc[inside], owner[: len(acc)][inside]
    else:
        acc, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        extra = np.fromiter((xxhash.xxh3_64_intdigest(h[start[i] : start[i] + n[i]].tobytes(), seed=7) for i in short.tolist()), np.uint64, len(short))
        acc, own = np.concatenate([acc, extra]), np.concatenate([own, short])
    order = np.argsort(acc, kind="stable")
    order = order[np.argsort(own[order], kind="stable")]
    acc, own = acc[order], own[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    acc, own = acc[keep], own[keep]
    return acc, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])


def sketches(elements: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` coordinates of each set (rows), by rounds of hashed bin placement.

    In round r every element draws a bin and a value; a bin takes the smallest value of the first round that reaches it. From
    round ``size`` on, round r places all elements in bin r - size, so after 2 * size rounds every coordinate of a set that is
    not empty is filled. Coordinates of two sets are equal with probability their Jaccard similarity, and sums of equal
    coordinates concentrate as for independent ones. Empty sets keep all coordinates at the largest value."""
    n = len(at) - 1
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, free, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    x = elements
    for r in range(2 * size):
        if not len(x):
            break
        drawn = mix(x + np.uint64(int(_ODD[0]) * (2 * r + 1) & (1 << 64) - 1))
        if r < size:
            place = owner * size + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            place = owner * size + (r - size)
        value = (np.uint64(r) << np.uint64(48)) | (mix(drawn + _ODD[1]) >> np.uint64(16))
        np.minimum.at(out, place, value)  # values of earlier rounds are smaller
        if r % 2 or r == 0:
            full = (out.reshape(n, size) != free).all(axis=1)
            left = ~full[owner]
            x, owner = x[left], owner[left]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of ``rows`` coordinates."""
    n, size = sketch.shape
    bands = size // rows
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[2], (n, bands)).copy()
    parts = sketch[:, : bands * rows].reshape(n, bands, rows)
    for i in range(rows):
        acc = mix(acc * _ODD[3] + parts[:, :, i])
    return acc
