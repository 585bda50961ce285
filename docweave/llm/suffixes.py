"""Two-stage suffix sorting of one block of byte strings, and what its adjacent common prefixes tell.

Only suffixes smaller than their successors are sorted directly: by their first symbols packed into a word, and those that tie
by their bytes. All others are induced by one scan over the buckets of first symbols in rising order: the predecessor of each
suffix met, if larger than it, goes to the next free place at the front of its own bucket. Scans are vectorised by bucket.
"""

from __future__ import annotations

import numpy as np

_BITS, _PER_WORD = np.uint64(9), 7
_STEP = 16


def join_with_ends(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 256 of all parts, each followed by an end symbol 0, and where each part begins."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(parts), np.uint16)
    inside = np.ones(len(text), bool)
    inside[at + sizes] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    return text, at


def packed_words(text: np.ndarray) -> np.ndarray:
    """At each place the next seven symbols as one number, which compares as they do. After an end symbol only zeros count, so
    no comparison looks past the end of a part."""
    padded = np.concatenate([text, np.zeros(_PER_WORD, np.uint16)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    going = np.ones(len(text), bool)
    for i in range(_PER_WORD):
        symbol = padded[i : i + len(text)]
        words = (words << _BITS) | np.where(going, symbol, np.uint64(0))
        going &= symbol > 0
    return words


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it, by the first symbol that differs; the last is not."""
    n = len(text)
    different = np.flatnonzero(text[:-1] != text[1:])
    nearest = np.searchsorted(different, np.arange(n), side="left")
    out = np.zeros(n, bool)
    has = nearest < len(different)
    at = different[nearest[has]]
    out[has] = text[at] < text[at + 1]
    return out


def _alike(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which neighbours in an order tie by their words; a word that holds an end leaves nothing to compare."""
    out = np.zeros(len(keys), bool)
    same = (keys[1:] == keys[:-1]) & (words[1:] & np.uint64(511) > 0)
    out[1:] = same
    out[:-1] |= same
    return out


def sort_directly(raw: bytes, begin: np.ndarray, end: np.ndarray, words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places ordered by their bytes, from ``begin`` to ``end`` of each in ``raw``; ties keep their order."""
    order = places[np.argsort(words[places], kind="stable")]
    first = words[order]
    at = np.flatnonzero(_alike(first, first))
    if len(at):
        tied = order[at]
        second = words[tied + _PER_WORD]
        order[at] = tied[np.lexsort((second, first[at]))]
        second = words[order[at] + _PER_WORD]
        both = np.cumsum(np.append(True, (first[at][1:] != first[at][:-1]) | (second[1:] != second[:-1])))
        at = at[_alike(both, second)]
    if len(at):
        tied = order[at]
        strings = [raw[a:b] for a, b in zip(begin[tied].tolist(), end[tied].tolist(), strict=True)]
        order[at] = tied[sorted(range(len(tied)), key=strings.__getitem__)]
    return order


def two_stage_order(raw: bytes, text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, the bytes ``raw`` with ends; of suffixes alike up to their ends the first comes first."""
    n = len(text)
    small = smaller_than_next(text)
    ends = np.flatnonzero(text == 0)
    part = np.cumsum(text == 0) - (text == 0)
    begin = np.arange(n) - part
    end = (ends - np.arange(len(ends)))[part]
    direct = sort_directly(raw, begin, end, words, np.flatnonzero(small))
    bucket = np.bincount(text, minlength=258)
    bounds = np.concatenate([[0], np.cumsum(bucket)])
    direct_bounds = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=258))])
    order = np.empty(n, np.int64)
    free = bounds[:-1].copy()

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Place predecessors that are larger; return those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        symbols = text[before]
        by = np.argsort(symbols, kind="stable")
        before, symbols = before[by], symbols[by]
        kinds, counts = np.unique(symbols, return_counts=True)
        start = 0
        own = before[:0]
        for s, k in zip(kinds.tolist(), counts.tolist(), strict=True):
            order[free[s] : free[s] + k] = before[start : start + k]
            free[s] += k
            if s == c:
                own = before[start : start + k]
            start += k
        return own

    # the last suffix has no successor: it is the end symbol, first of its bucket
    order[0] = n - 1
    free[0] = 1
    for c in np.flatnonzero(bucket).tolist():
        induced = order[bounds[c] : free[c]].copy()
        while len(induced):  # runs of one symbol induce within their bucket
            induced = induce(induced, c)
        sorted_here = direct[direct_bounds[c] : direct_bounds[c + 1]]
        order[bounds[c + 1] - len(sorted_here) : bounds[c + 1]] = sorted_here
        induce(sorted_here, c)
    return order


def _prefixes(words: np.ndarray, one: np.ndarray, two: np.ndarray, least: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, known to be ``least`` or more, up to ``depth``; ends don't match."""
    last = len(words) - 1
    h = least.copy()
    going = np.flatnonzero(h < depth)
    while len(going):
        x, y = words[np.minimum(one[going] + h[going], last)], words[np.minimum(two[going] + h[going], last)]
        same = (x == y) & (x & np.uint64(511) > 0)
        stopped, x, y = going[~same], x[~same], y[~same]
        alike = np.ones(len(stopped), bool)
        for i in range(_PER_WORD):
            shift = np.uint64(9 * (_PER_WORD - 1 - i))
            p, q = x >> shift & np.uint64(511), y >> shift & np.uint64(511)
            alike &= (p == q) & (p > 0)
            h[stopped] += alike
        going = going[same]
        h[going] += _PER_WORD
        going = going[h[going] < depth]
    return np.minimum(h, depth)


def adjacent_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order, up to ``depth``. A suffix has at least one
    symbol less in common with its neighbour than the suffix that begins one place earlier; so every ``_STEP``-th place is
    compared from the start, and those between from there on."""
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    known = np.zeros(n, np.int64)
    places = np.arange(0, n, _STEP)
    places = places[before[places] >= 0]
    known[places] = _prefixes(words, places, before[places], np.zeros(len(places), np.int64), depth + _STEP)
    rest = np.flatnonzero((np.arange(n) % _STEP > 0) & (before >= 0))
    least = np.maximum(0, known[rest // _STEP * _STEP] - rest % _STEP)
    known[rest] = _prefixes(words, rest, before[rest], least, depth)
    return np.minimum(known, depth)[order]


def repeated_starts(parts: list[bytes], owner: np.ndarray, first: np.ndarray, size: np.ndarray, times: np.ndarray, length: int) -> list[np.ndarray]:
    """Members are ``size`` places of their part from ``first`` on, and stand ``times`` altogether. For each, which of its places
    begin a string of ``length`` bytes that also begins at a member's place elsewhere."""
    text, at = join_with_ends(parts)
    words = packed_words(text)
    order = two_stage_order(b"".join(parts), text, words)
    prefix = adjacent_prefixes(words, order, length)
    start = at[owner] + first
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start, times)
    np.add.at(edge, start + size, -times)
    weight = np.cumsum(edge)[:-1][order]
    group = np.cumsum(prefix < length)
    sizes = np.bincount(group, weights=weight, minlength=1)
    found = np.zeros(len(text), bool)
    found[order] = (weight > 0) & (sizes[group] > 1)
    return [np.flatnonzero(found[a : a + k]) for a, k in zip(start.tolist(), size.tolist(), strict=True)]
