"""Best-fit packing of whole pieces into as few sequences as possible, after dominance reduction.

Packing depends on lengths only, and there are at most ``window`` different ones. So Spark counts the pieces of each length, and
the plan is made from that histogram (``window`` numbers at most, whatever the number of documents) as patterns: a list of lengths
and how many sequences are filled like that. Spark then numbers the pieces of each length and gives each its place.

The plan first reduces the instance as Martello and Toth do: for a piece j, a set of at most three pieces with j in it is fixed as a
sequence for good if it dominates every other set that j can be in, that is, if for each such set the pieces beside j can be
exchanged for those of the fixed set without needing more room elsewhere. No optimum is lost by that:

- nothing else fits beside j: j alone;
- the largest piece a that fits fills the window, or no two pieces fit beside j: {j, a};
- no three fit beside j, and no pair does whose sum is above a: {j, a}; or b is the largest that fits beside a, and no two pieces
  above b fit together: {j, a, b}.

What the rules leave is packed by best fit, longest first: each piece goes to the open sequence with the least room that is enough.
Both work on counts, many equal sequences at a time.

Numbering without a window over a whole length: pieces are written with the task that wrote them and their row in it, numbered
among the task's pieces of their length, and the counts by (task, length) are summed up over tasks, so each piece adds its
task's start. A common length is thus spread over all tasks.

Defined results: a null or empty text is a piece of one id (by ``tokenize_pieces``); repeated rows are packed separately; which of
the pieces of one length takes which place follows the order they are read in; an empty table gives an empty result; other
columns are carried along, but for sequence_id and offset, which the operator's own replace.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import materialize, renamed

Batches = Iterator[pa.RecordBatch]
#: Lengths with how many pieces of each, in the order they stand in a sequence, and how many sequences are like that.
Pattern = tuple[tuple[tuple[int, int], ...], int]


class Lengths:
    """A multiset of lengths with what the rules ask of it."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.sorted = sorted(self.counts)

    def take(self, chosen: Counter, times: int) -> None:
        for n, k in chosen.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                del self.counts[n]
                del self.sorted[bisect_left(self.sorted, n)]

    def smallest(self, k: int, without: Counter, above: int = 0) -> list[int]:
        """The k smallest pieces longer than ``above``, with those in ``without`` set aside (fewer if there are fewer)."""
        found: list[int] = []
        for i in range(bisect_right(self.sorted, above), len(self.sorted)):
            n = self.sorted[i]
            found += [n] * min(k - len(found), self.counts[n] - without[n])
            if len(found) == k:
                break
        return found

    def largest(self, room: int, without: Counter) -> int | None:
        """The longest piece of at most ``room``, with those in ``without`` set aside."""
        for i in range(bisect_right(self.sorted, room) - 1, -1, -1):
            if self.counts[self.sorted[i]] > without[self.sorted[i]]:
                return self.sorted[i]
        return None


def dominating(lengths: Lengths, j: int, window: int) -> list[int] | None:
    """A set of at most three pieces with j in it that dominates all others with j, or None if the rules find none."""
    room, own = window - j, Counter([j])
    a = lengths.largest(room, own)
    if a is None:
        return [j]
    first = lengths.smallest(3, own)
    if a == room or len(first) < 2 or first[0] + first[1] > room:
        return [j, a]
    if len(first) < 3 or sum(first) > room:  # at most two pieces beside j
        beside = Counter([j, a])
        b = lengths.largest(room - a, beside)
        # pairs of pieces above b (or of any, if none fits beside a) that fit together are not covered by {a, b}
        above = lengths.smallest(2, own, b or 0)
        if len(above) < 2 or sum(above) > room:
            return [j, a] if b is None else [j, a, b]
        if _largest_pair(lengths, room, own) <= a:
            return [j, a]
    return None


def _largest_pair(lengths: Lengths, room: int, without: Counter) -> int:
    """The largest sum of two pieces that is at most ``room`` (0 if no two fit)."""
    best = 0
    for x in lengths.sorted[: bisect_right(lengths.sorted, room)]:
        if lengths.counts[x] > without[x]:
            y = lengths.largest(min(room - x, x), without + Counter([x]))
            if y is not None:
                best = max(best, x + y)
    return best


def reduce_instance(counts: dict[int, int], window: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and the counts of the lengths that are left."""
    lengths = Lengths(counts)
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(lengths.counts, reverse=True):
            while j in lengths.counts and (found := dominating(lengths, j, window)):
                chosen = Counter(found)
                # the rules hold on as pieces go, since only shorter lists of smallest and largest ones are left
                times = min(lengths.counts[n] // k for n, k in chosen.items())
                lengths.take(chosen, times)
                fixed.append((tuple(chosen.items()), times))
                changed = True
    return fixed, lengths.counts


@dataclass
class _Open:
    """Equal open sequences: their room, how many there are and what they hold."""

    room: int
    many: int
    holds: tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], window: int) -> list[Pattern]:
    """Best fit of all pieces, longest first, on counts: equal open sequences are filled together."""
    by_room: dict[int, list[_Open]] = {}
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(room: int, many: int, holds: tuple[tuple[int, int], ...]) -> None:
        if not many:
            return
        if not room:
            done.append((holds, many))
            return
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        by_room[room].append(_Open(room, many, holds))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = window // n
                full, rest = divmod(left, each)
                put(window - each * n, full, ((n, each),))
                if rest:
                    put(window - rest * n, 1, ((n, rest),))
                break
            group = by_room[rooms[i]].pop()
            if not by_room[rooms[i]]:
                del by_room[rooms.pop(i)]
            each = group.room // n
            full = min(group.many, left // each)
            rest = min(left - full * each, each - 1) if full < group.many else 0
            put(group.room - each * n, full, (*group.holds, (n, each)))
            if rest:
                put(group.room - rest * n, 1, (*group.holds, (n, rest)))
            put(group.room, group.many - full - bool(rest), group.holds)
            left -= full * each + rest
    return done + [(g.holds, g.many) for groups in by_room.values() for g in groups]


def plan_sequences(counts: dict[int, int], window: int) -> list[Pattern]:
    """Patterns for all pieces of the histogram."""
    if any(not 0 < n <= window for n in counts):
        raise ValueError("lengths must lie between 1 and the window")
    fixed, left = reduce_instance(counts, window)
    return fixed + best_fit(left, window)


class Places:
    """Sequence and offset of the i-th piece of a length, looked up in arrays sorted by (length, first piece of an entry)."""

    def __init__(self, plan: list[Pattern]) -> None:
        taken: Counter = Counter()
        rows: list[tuple[int, int, int, int, int]] = []
        base = 0
        for holds, many in plan:
            at = 0
            for n, k in holds:
                rows.append((n, taken[n], base, k, at))
                taken[n] += k * many
                at += n * k
            base += many
        rows.sort()
        self.length, self.first, self.base, self.each, self.at = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        values, starts, sizes = np.unique(self.length, return_index=True, return_counts=True)
        self.begins = {n: (a, a + m) for n, a, m in zip(values.tolist(), starts.tolist(), sizes.tolist(), strict=True)}

    def find(self, lengths: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        values, starts = np.unique(lengths[order], return_index=True)
        for n, a, b in zip(values.tolist(), starts, np.append(starts[1:], len(order)), strict=True):
            own = order[a:b]
            lo, hi = self.begins[n]
            entry = lo + np.searchsorted(self.first[lo:hi], nth[own], "right") - 1
            place = nth[own] - self.first[entry]
            sequence[own] = self.base[entry] + place // self.each[entry]
            offset[own] = self.at[entry] + place % self.each[entry] * n
        return sequence, offset


def _place(places: Broadcast, n_carry: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            length, nth = (batch.column(n_carry + i).to_numpy() for i in range(2))
            sequence, offset = places.value.find(length, nth)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carry], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:n_carry], "sequence_id", "offset"])

    return run


def pack_best_fit(pieces: DataFrame, *, window: int = 4096, length_col: str = "length") -> DataFrame:
    """Give every piece (of 1 to ``window`` ids) a sequence_id, from 0 on, and an offset in it; all columns are carried."""
    spark = pieces.sparkSession
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset")))
    carried, back = renamed(pieces)
    length = carried.columns[pieces.columns.index(length_col)]
    read = carried.withColumn(length, F.col(length).cast("long")).withColumn("row", F.monotonically_increasing_id())
    written = materialize(read.withColumn("task", F.shiftright("row", 33)), "packing-pieces")
    cells = materialize(written.groupBy("task", length).agg(F.count(F.lit(1)).alias("n")), "packing-cells")
    counts = {r[length]: r["n"] for r in cells.groupBy(length).agg(F.sum("n").alias("n")).collect()}  # window rows at most
    places = spark.sparkContext.broadcast(Places(plan_sequences(counts, window)))
    tasks_before = Window.partitionBy(length).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("task", length, F.coalesce(F.sum("n").over(tasks_before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("task", length).orderBy("row")) - 1
    numbered = written.withColumn("own", own).join(starts, ["task", length])
    found = numbered.select(*carried.columns, F.col(length).alias("size"), (F.col("start") + F.col("own")).alias("nth"))
    out = T.StructType([*written.schema.fields[: len(carried.columns)], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return back(found.mapInArrow(_place(places, len(carried.columns)), out))
