"""Removing byte strings that stand in more than one place, by suffix sorting of what may repeat.

1. Every string of ``length`` bytes has one anchor, its k-gram with the smallest hash (the first on ties), so equal strings have
   equal anchors at equal offsets. Successive strings with the same anchor form a context: one row an anchor, about one for
   190 bytes. Only anchors whose hash is met twice go on.
2. Contexts that are equal as a whole (64-bit hash beside the 64-bit anchor) are one kind, which counts as often as it stands;
   kinds are counted before anything is sorted, so copies of any number cost no more than one.
3. Kinds are dealt by anchor into blocks of bounded size. A block is suffix sorted in two stages, and groups of adjacent common
   prefixes of ``length`` tell which strings stand in two places. Where an anchor has very many kinds (a passage that a large
   part of all documents share, say), kinds are cut into cells of successive strings by their offset to the anchor, and dealt by
   what all strings of the full cell have in common; cells that this brings together with too many others are cut again, at last
   into single strings. Hashes only deal out: whatever repeats is found by the sort.
4. What is found in a kind holds wherever it stands; ranges are brought to their texts, merged and cut out.

Rows are told apart by id and a hash of the text. Defined results: a null or empty text has 0 bytes and nothing removed; a row
repeated as a whole counts as another place; ids may be null; strings never cross documents; an empty table gives an empty
result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.bloom import membership, spread
from docweave.llm.common import byte_slices, fresh_name, materialize, shielded
from docweave.llm.suffixes import repeated_starts

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 25) - 1)
_BATCH = 2 << 20
#: Strings in a cell, from the first cut on; the last must be 1.
_CELLS = (64, 8, 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed hash of the k bytes from each place on."""
    n = len(data)
    symbols = spread(np.arange(1, 257))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols[data] * _powers(_BASE, n), out=sums[1:])
    rolled = (sums[k:] - sums[:-k]) * _powers(_BASE_INVERSE, n - k + 1)
    return spread(rolled.view(np.int64))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values, by running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts one after the other (``at``: their bounds): text number, first string's place, number of strings, offset of the
    anchor from that place, and anchor hash of every context."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    grams = gram_hashes(data, gram)
    low = window_minima((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    anchor = (low & _PLACE).astype(np.int64)
    counts = np.maximum(0, np.diff(at) - length + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + at[text]
    if not len(starts):
        return none
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    return text[first], starts[first], n, own[first] - starts[first], grams[own[first]]


def _joined(binary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column one after the other, and bounds."""
    sizes = pc.binary_length(binary).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(binary.to_pylist()), np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])


_OCCURRENCE = "id long, row long, start int, n int, offset int, anchor long, kind long"


def _occurrences(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            for a, b in byte_slices(sizes, _BATCH):
                data, at = _joined(batch.column(2).slice(a, b - a))
                # a text over the batch size is read in overlapping slices, so places fit their bits
                for lo, hi, base in _stretches(at, length):
                    text, start, n, offset, anchor = contexts(data[lo:hi], at[base[0] : base[1] + 1].clip(lo, hi) - lo, length, gram)
                    start = start + lo
                    raw = memoryview(data)
                    kind = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + k + length - 1], seed=o) for s, k, o in zip(start.tolist(), n.tolist(), offset.tolist(), strict=True)), np.uint64, len(start))
                    text = text + base[0]
                    rows = pa.array(text + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - at[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64))], names=["id", "row", "start", "n", "offset", "anchor", "kind"])

    return run


def _stretches(at: np.ndarray, length: int, most: int = 1 << 24) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Byte ranges of at most ``most`` bytes and the texts in them: all texts, or overlapping slices of a single longer one
    whose strings each begin in one slice only."""
    if at[-1] <= most or len(at) > 2:
        yield 0, int(at[-1]), (0, len(at) - 1)
        return
    for lo in range(0, int(at[-1]), most - length):
        yield lo, min(int(at[-1]), lo + most - 1), (0, 1)
        if lo + most - 1 >= at[-1]:
            return


def _extract(contains: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(contains(batch.column(1).to_numpy(zero_copy_only=False))))

    return run


_CUT = "mixed boolean, anchors array<long>, kinds array<long>, sizes array<int>, times array<long>, offset int, bytes binary"
#: Strings in a stretch of joined kinds.
_STRETCH = 1024


def _stretches_of(start: list[int], n: list[int], mixed: list[bool]) -> list[list[int]]:
    """Kinds of one text that follow each other, joined while their anchors have one kind each: those need not meet others."""
    out: list[list[int]] = []
    end = held = -1
    for i in sorted(range(len(start)), key=start.__getitem__):
        if mixed[i] or start[i] != end or held + n[i] > _STRETCH:
            out.append([i])
            held = 0
        else:
            out[-1].append(i)
        end, held = -1 if mixed[i] else start[i] + n[i], held + n[i]
    return out


def _cut_contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kinds with their bytes, cut out of the texts (raw) by the lists of what is asked of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for lo, hi in byte_slices(pc.binary_length(batch.column(0)).to_pylist(), _BATCH):
                asked = lists.slice(lo, hi - lo)
                fields = {k: pc.struct_field(asked.flatten(), k) for k in ("mixed", "anchor", "kind", "times", "start", "n", "offset")}
                start, n, mixed, offset = (fields[k].to_pylist() for k in ("start", "n", "mixed", "offset"))
                sizes = pc.list_value_length(asked).to_pylist()
                members, bounds, flags, offsets, cut = [], [0], [], [], []
                base = 0
                for raw, k in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), sizes, strict=True):
                    for one in _stretches_of(start[base : base + k], n[base : base + k], mixed[base : base + k]):
                        members += [base + i for i in one]
                        bounds.append(len(members))
                        flags.append(mixed[base + one[0]])
                        offsets.append(offset[base + one[0]])
                        last = base + one[-1]
                        cut.append(raw[start[base + one[0]] : start[last] + n[last] + length - 1])
                    base += k
                at, take = pa.array(bounds, pa.int32()), pa.array(members, pa.int64())
                own = [pa.ListArray.from_arrays(at, fields[k].take(take)) for k in ("anchor", "kind", "n", "times")]
                yield pa.RecordBatch.from_arrays([pa.array(flags, pa.bool_()), *own, pa.array(offsets, pa.int32()), pa.array(cut, pa.binary())], names=["mixed", "anchors", "kinds", "sizes", "times", "offset", "bytes"])

    return run


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of successive places."""
    if not len(found):
        return found, found
    edge = np.flatnonzero(np.diff(found) > 1)
    first = np.concatenate([found[:1], found[edge + 1]])
    last = np.concatenate([found[edge], found[-1:]])
    return first, last - first + 1


_RUNS = "array<struct<at: int, n: int>>"
_RUN = f"anchor long, kind long, runs {_RUNS}"


def _sort_block(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        lists = {k: pa.concat_arrays(block.column(k).chunks) for k in ("anchors", "kinds", "sizes", "times")}
        owner = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists["sizes"]).to_numpy())
        anchors, kinds, sizes, times = (lists[k].flatten() for k in ("anchors", "kinds", "sizes", "times"))
        size = sizes.to_numpy().astype(np.int64)
        # where each member begins in its part
        ahead = np.cumsum(size) - size
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        first = ahead - ahead[begins][owner]
        row, at, n, bounds = [], [], [], [0]
        for i, f in enumerate(repeated_starts(block.column("bytes").to_pylist(), owner, first, size, times.to_numpy(), length)):
            if len(f):
                a, k = _runs(f)
                row.append(i)
                at.append(a)
                n.append(k)
                bounds.append(bounds[-1] + len(a))
        take = pa.array(row, pa.int64())
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32()) for x in (at, n)]
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(flat, ["at", "n"]))
        return pa.table({"anchor": anchors.take(take), "kind": kinds.take(take), "runs": runs})

    return run


def _merged(found: DataFrame) -> DataFrame:
    """One row a kind, with its runs in order, joined where they touch."""
    runs = found.groupBy("anchor", "kind").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))
    last = "element_at(a, -1)"
    joined = f"concat(slice(a, 1, size(a) - 1), array(named_struct('at', {last}.at, 'n', greatest({last}.n, x.at + x.n - {last}.at))))"
    return runs.select("anchor", "kind", F.expr(f"aggregate(runs, cast(array() as {_RUNS}), (a, x) -> case when size(a) > 0 and x.at <= {last}.at + {last}.n then {joined} else concat(a, array(x)) end)").alias("runs"))


def _sorted_in_blocks(rows: DataFrame, *, length: int, block_bytes: int) -> DataFrame:
    """Runs of repeated strings in rows (place: what equal strings have in common, anchors, kinds, sizes, times, bytes)."""
    total = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    block = F.pmod(F.col("place"), F.lit(max(1, -(-int(total) // block_bytes))))
    return rows.withColumn("block", block).drop("place").groupBy("block").applyInArrow(_sort_block(length), _RUN)


_CELL = "anchor long, part long, kind long, times long, offset int, n int, whole long, at int"


def _cells(length: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of ``width`` successive strings of each kind (``whole``, from place ``at`` on), by their offset to the anchor. A
    cell's part is a hash of the bytes that all strings of the full cell have in common; its kind one of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {k: [] for k in ("i", "part", "kind", "offset", "n", "at")}
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("n", "offset", "bytes")]
            for i, (n, offset, raw) in enumerate(zip(*columns, strict=True)):
                # a string with its anchor d bytes on lies in cell d div width
                d_last = offset - n + 1
                for cell in range(d_last // width, offset // width + 1):
                    d_high, d_low = min(offset, (cell + 1) * width - 1), max(d_last, cell * width)
                    s0, s1 = offset - d_high, offset - d_low
                    core = raw[offset - cell * width : offset - ((cell + 1) * width - 1) + length]
                    out["i"].append(i)
                    out["part"].append(xxhash.xxh3_64_intdigest(core, seed=cell))
                    out["kind"].append(xxhash.xxh3_64_intdigest(raw[s0 : s1 + length], seed=d_high))
                    out["offset"].append(d_high)
                    out["n"].append(s1 - s0 + 1)
                    out["at"].append(s0)
            rows = pa.array(out["i"], pa.int64())
            hashes = [pa.array(np.array(out[k], np.uint64).view(np.int64)) for k in ("part", "kind")]
            places = [pa.array(out[k], pa.int32()) for k in ("offset", "n", "at")]
            anchor, kind, times = (batch.column(batch.schema.get_field_index(k)).take(rows) for k in ("anchor", "kind", "times"))
            yield pa.RecordBatch.from_arrays([anchor, *hashes, times, places[0], places[1], kind, places[2]], names=["anchor", "part", "kind", "times", "offset", "n", "whole", "at"])

    return run


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for raw, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = raw or b""
                out, gone, n, end = [], 0, 0, 0
                for s, k in sorted((r["start"], r["n"]) for r in ranges or ()):
                    stop = s + k + length - 1
                    if s > end or not n:
                        out.append(raw[end:s])
                        n += 1
                        gone += stop - s
                    else:
                        gone += max(0, stop - end)
                    end = max(end, stop)
                out.append(raw[end:])
                kept.append(b"".join(out))
                removed.append(gone)
                spans.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=[*batch.schema.names[2:], "kept", "n_removed", "n_spans"])

    return run


def _sorted_runs(kinds: DataFrame, *, length: int, block_bytes: int, hot_kinds: int, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, kind, runs) where repeated strings begin in kinds (anchor, part, kind, times, offset, n, bytes);
    equal strings have equal anchors and parts."""
    crowded = kinds.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > hot_kinds)
    crowded = materialize(crowded.select("anchor", "part", F.lit(True).alias("crowded")), "crowded-parts")
    few = kinds
    many = None
    if not crowded.isEmpty():
        marked = materialize(kinds.join(crowded, ["anchor", "part"], "left"), "marked-kinds")
        few, many = marked.where("crowded is null").drop("crowded"), marked.where("crowded").drop("crowded")
    each = [F.array(c).alias(name) for c, name in (("anchor", "anchors"), ("kind", "kinds"), ("n", "sizes"), ("times", "times"))]
    runs = _sorted_in_blocks(few.select(F.xxhash64("anchor", "part").alias("place"), *each, "bytes"), length=length, block_bytes=block_bytes)
    if many is None:
        return runs
    width, *narrower = widths
    cells = materialize(many.mapInArrow(_cells(length, width), _CELL), "cells")
    met = materialize(cells.groupBy("anchor", "part").agg(F.sum("times").alias("met")).where("met > 1").drop("met"), "met-cells")
    cells = materialize(cells.join(met, ["anchor", "part"]), "shared-cells")
    own = cells.groupBy("anchor", "part", "kind").agg(F.sum("times").alias("times"), F.min(F.struct("whole", "at", "offset", "n")).alias("one"))
    own = own.select("anchor", "part", "kind", "times", "one.*")
    whole = many.select("anchor", F.col("kind").alias("whole"), "bytes")
    cut = own.join(whole, ["anchor", "whole"]).select("anchor", "part", "kind", "times", "offset", "n", F.expr(f"substring(bytes, at + 1, n + {length - 1})").alias("bytes"))
    found = _sorted_runs(materialize(cut, "cell-bytes"), length=length, block_bytes=block_bytes, hot_kinds=hot_kinds, widths=tuple(narrower))
    found = materialize(_merged(found), "cell-runs")
    shifted = F.expr(f"cast(transform(runs, r -> named_struct('at', r.at + at, 'n', r.n)) as {_RUNS})")
    return runs.union(cells.join(found, ["anchor", "kind"]).select("anchor", F.col("whole").alias("kind"), shifted.alias("runs")))


def repeated_ranges(keyed: DataFrame, *, length: int, gram: int, block_bytes: int, hot_kinds: int) -> DataFrame:
    """(id, row, ranges: start, n) where repeated strings begin in the texts (id, row, raw); several rows a text."""
    found = materialize(keyed.mapInArrow(_occurrences(length, gram), _OCCURRENCE), "contexts")
    # each side of a join is written first: plain reads can be split where an anchor or kind is very common
    met = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("met"), (F.min("kind") != F.max("kind")).alias("mixed")).where("met > 1").drop("met")
    shared = materialize(found.join(materialize(met, "met-anchors"), "anchor"), "shared-contexts")
    one = F.min(F.struct("id", "row", "start", "n", "offset", "mixed")).alias("one")
    kinds = shared.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("times"), one)
    kinds = materialize(kinds.select("anchor", "kind", "times", "one.*"), "context-kinds")
    contains = membership(kinds.select("row"), kinds.count())
    asked = kinds.groupBy("id", "row").agg(F.collect_list(F.struct("mixed", "anchor", "kind", "times", "start", "n", "offset")).alias("asked"))
    texts = keyed.mapInArrow(_extract(contains), "id long, row long, raw binary").dropDuplicates(["id", "row"])
    cut = materialize(texts.join(asked, ["id", "row"]).select("raw", "asked").mapInArrow(_cut_contexts(length), _CUT), "kind-bytes")
    alone = cut.where("not mixed").select(F.xxhash64("anchors").alias("place"), "anchors", "kinds", "sizes", "times", "bytes")
    mixed = cut.where("mixed").selectExpr("anchors[0] as anchor", "0L as part", "kinds[0] as kind", "times[0] as times", "offset", "sizes[0] as n", "bytes")
    runs = _sorted_runs(mixed, length=length, block_bytes=block_bytes, hot_kinds=hot_kinds, widths=_CELLS)
    runs = runs.union(_sorted_in_blocks(alone, length=length, block_bytes=block_bytes))
    runs = materialize(_merged(runs), "kind-runs")
    ranges = F.expr("transform(runs, r -> named_struct('start', start + r.at, 'n', r.n))")
    return shared.join(runs, ["anchor", "kind"]).select("id", "row", ranges.alias("ranges"))


@shielded(id_col="doc_id", text_col="text")
def remove_repeats(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", length: int = 400, gram: int = 150, block_bytes: int = 1 << 18, hot_kinds: int = 128) -> DataFrame:
    """``docs`` without its text, and kept (binary: the text's bytes that no repeated string of ``length`` bytes covers),
    n_bytes, n_removed and n_spans (maximal removed runs)."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    ident, row = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.xxhash64(raw)
    keyed = docs.select(ident.alias("id"), row.alias("row"), raw.alias("raw"))
    ranges = repeated_ranges(keyed.where(F.length("raw") >= length), length=length, gram=gram, block_bytes=block_bytes, hot_kinds=hot_kinds)
    per_row = ranges.groupBy("id", "row").agg(F.flatten(F.collect_set("ranges")).alias("__ranges"))
    per_row = materialize(per_row, "ranges").withColumnsRenamed({"id": "__range_id", "row": "__range_row"})
    own = {"kept", "n_bytes", "n_removed", "n_spans"}
    columns = [c for c in docs.columns if c != text_col and c.lower() not in own]
    i, r, b = fresh_name(docs, "__i"), fresh_name(docs, "__r"), fresh_name(docs, "__raw")
    left = docs.select(*columns, ident.alias(i), row.alias(r), raw.alias(b))
    joined = left.join(per_row, (F.col(i) == F.col("__range_id")) & (F.col(r) == F.col("__range_row")), "left")
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    return joined.select(b, "__ranges", *columns, F.octet_length(b).cast("long").alias("n_bytes")).mapInArrow(_cut_out(length), schema)
