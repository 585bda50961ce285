"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. Sketches of each document's shingle set give band keys; equal sets (128-bit hash) form classes, and only one document
   of each class goes on.
2. Classes that share a band key are candidates. In small buckets all pairs are. In a large one, where all pairs would grow with
   the square of the group, each class is first tried with the middle one of a sample of its largest bucket, which ties most of a
   group of copies together. Where a large bucket still holds several parts, every class outside its largest part is compared
   with all others in blocks of bounded size: exact sizes of all intersections by matrix products, inside tasks, which report
   links between parts only.
3. Every link is confirmed on full shingle sets, read anew for candidate classes only.
4. Links that hold are merged by components.

With 26 bands of 5 coordinates a pair at similarity 0.85 misses all bands with probability 2.4e-7; more alike pairs, less. No pair
that shares a band is left out, unless a path of confirmed links joins it.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text with fewer words than the
shingle width is one shingle; rows with a null id are linked with nothing, component null, kept; rows that share an id are one
node, with the links of all their texts; equal texts are linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.llm.bloom import membership
from docweave.llm.common import byte_slices, materialize, shielded
from docweave.llm.graph import components
from docweave.llm.shingles import band_keys, shingle_sets, sketches

#: Buckets up to this size are tried pair by pair; of larger ones this many classes are looked at to find a middle one.
_SMALL, _SAMPLE = 16, 32
#: Most classes and about most shingles in one side of a block.
_BLOCK, _ELEMENTS = 1024, 1 << 19
_COLUMNS = 2048
_BATCH = 16 << 20


def _digests(elements: np.ndarray, at: np.ndarray, ids: list[int | None]) -> list[bytes | None]:
    """Names of the classes of equal sets; an empty set is a class of its own for each id, a null id has none."""
    each = zip(at[:-1].tolist(), at[1:].tolist(), ids, strict=True)
    return [None if name is None else xxhash.xxh3_128_digest(elements[i:j].tobytes()) if j > i else name.to_bytes(8, "big", signed=True) for i, j, name in each]


def _signatures(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in byte_slices(pc.binary_length(texts).to_pylist(), _BATCH):
                elements, at = shingle_sets(texts.slice(a, b - a), width)
                short = sketches(elements, at, bands * rows)
                keys = band_keys(short, rows)
                ids = batch.column(0).slice(a, b - a)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                packed = pa.array([s.tobytes() for s in short.astype(np.uint32)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(_digests(elements, at, ids.to_pylist()), pa.binary()), flat, packed], names=["id", "n", "cls", "bands", "sketch"])

    return run


def _sets(width: int, contains: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = contains(batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(wanted))
            for a, b in byte_slices(pc.binary_length(batch.column(1)).to_pylist(), _BATCH):
                elements, at = shingle_sets(batch.column(1).slice(a, b - a), width)
                flat = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
                names = _digests(elements, at, batch.column(0).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), flat], names=["cls", "elements"])

    return run


def _middle(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The class of a sample of a bucket whose sketch agrees most with the others'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        x = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(-1, size)
        agree = np.array([(x == row).sum() for row in x])
        return pdf.iloc[[int(agree.argmax())]][["band", "key", "cls"]].rename(columns={"cls": "hub"})

    return run


def _common_sizes(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one side with every set of the other; a side is (elements, bounds)."""
    (x, x_at), (y, y_at) = one, two
    shared = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    out = np.zeros((len(x_at) - 1, len(y_at) - 1), np.float32)
    sides = []
    for values, at in (one, two):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        held = shared[place] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(place[held], kind="stable")
        sides.append((row[held][order], place[held][order]))
    for c in range(0, len(shared), _COLUMNS):
        dense = []
        for (row, place), at in zip(sides, (x_at, y_at), strict=True):
            a, b = np.searchsorted(place, [c, c + _COLUMNS])
            m = np.zeros((len(at) - 1, min(_COLUMNS, len(shared) - c)), np.float32)
            m[row[a:b], place[a:b] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _between(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between different parts of one block of a bucket, no more than are needed to join those that are linked."""

    def run(block: pa.Table) -> pa.Table:
        sides = []
        for k in (0, 1):
            rows = block.filter(pc.equal(block.column("side"), k)).combine_chunks()
            lists = rows.column("elements").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            sides.append((rows.column("cls").to_pylist(), rows.column("part").to_pylist(), (lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])), n))
        (one, own, x, nx), (two, others, y, ny) = sides
        common = _common_sizes(x, y).astype(np.int64)
        i, j = np.nonzero(100 * common >= percent * (nx[:, None] + ny[None, :] - common))
        head: dict[bytes, bytes] = {}

        def find(p: bytes) -> bytes:
            while head.setdefault(p, p) != p:
                head[p] = head[head[p]]
                p = head[p]
            return p

        found = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(own[a]), find(others[b])
            if p != q:
                head[p] = q
                found.append((one[a], two[b]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return run


class _Search:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> None:
        self.width, self.percent, self.bands, self.rows = width, percent, bands, rows
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(self) -> DataFrame:
        """(id, n, component) of every row."""
        schema = "id long, n long, cls binary, bands array<long>, sketch binary"
        signed = materialize(self.texts.mapInArrow(_signatures(self.width, self.bands, self.rows), schema), "signatures")
        named = signed.where("id is not null")
        classes = materialize(named.groupBy("cls").agg(F.min("id").alias("head"), F.min("n").alias("n")), "classes")
        # ids on several texts tie their classes together
        several = named.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("id", "a")
        ties = named.select("id", "cls").join(several, "id").select("a", F.col("cls").alias("b"))
        linked = components(self.links(signed, classes.where("n > 0")).union(ties))
        rooted = classes.join(linked, classes["cls"] == linked["node"], "left").select("cls", "head", F.coalesce("component", "cls").alias("root"))
        rooted = materialize(rooted, "class-roots")
        lowest = rooted.groupBy("root").agg(F.min("head").alias("component"))
        # written first: a join whose sides are both plain reads can split a class that has very many rows
        found = materialize(rooted.join(lowest, "root").select("cls", "component"), "class-components")
        return signed.select("id", "n", "cls").join(found, "cls", "left").select("id", "n", "component")

    def links(self, signed: DataFrame, classes: DataFrame) -> DataFrame:
        """Confirmed links (a, b) between classes, enough of them to have the same components as all."""
        one = signed.join(classes.select("cls", F.col("head").alias("id")), ["cls", "id"], "left_semi").dropDuplicates(["cls"])
        one = materialize(one, "class-signatures")
        keyed = one.select("id", "cls", "n", F.posexplode("bands").alias("band", "key"))
        shared = materialize(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
        buckets = materialize(keyed.join(shared, ["band", "key"]), "buckets")
        wanted = buckets.select("id").distinct()
        n_wanted = wanted.count()
        if not n_wanted:
            return buckets.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
        contains = membership(wanted, n_wanted)
        sets = self.texts.where("id is not null").mapInArrow(_sets(self.width, contains), "cls binary, elements array<long>")
        self.sets = materialize(sets.dropDuplicates(["cls"]), "shingle-sets")
        small = buckets.where(F.col("size") <= _SMALL)
        pairs = small.alias("x").join(small.alias("y"), ["band", "key"]).where("x.cls < y.cls").select(F.col("x.cls").alias("a"), F.col("x.n").alias("na"), F.col("y.cls").alias("b"), F.col("y.n").alias("nb"))
        large = buckets.where(F.col("size") > _SMALL)
        found = pairs.union(self.with_middles(large, one))
        found = found.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).select("a", "b").distinct()
        links = materialize(self.confirm(found), "confirmed")
        if large.isEmpty():
            return links
        return links.union(materialize(self.between_parts(large, links), "part-links"))

    def with_middles(self, large: DataFrame, one: DataFrame) -> DataFrame:
        """Each class with the middle one of its largest bucket."""
        largest = large.groupBy("cls", "n").agg(F.max(F.struct("size", "band", "key")).alias("b")).select("cls", "n", "b.band", "b.key")
        largest = materialize(largest, "largest-buckets")
        place = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.xxhash64("cls"), "cls"))
        sample = largest.withColumn("place", place).where(F.col("place") <= _SAMPLE).select("band", "key", "cls")
        middles = sample.join(one.select("cls", "sketch"), "cls").groupBy("band", "key").applyInPandas(_middle(self.bands * self.rows), "band int, key long, hub binary")
        middles = materialize(middles.join(one.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n")), "hub"), "middles")
        tried = largest.join(middles, ["band", "key"]).where("cls <> hub")
        swap = F.col("cls") > F.col("hub")
        return tried.select(F.least("cls", "hub").alias("a"), F.when(swap, F.col("hub_n")).otherwise(F.col("n")).alias("na"), F.greatest("cls", "hub").alias("b"), F.when(swap, F.col("n")).otherwise(F.col("hub_n")).alias("nb"))

    def between_parts(self, large: DataFrame, links: DataFrame) -> DataFrame:
        """Links between the parts that large buckets still hold."""
        named = components(links)
        parts = large.join(named, large["cls"] == named["node"], "left").select("cls", "n", "band", "key", F.coalesce("component", "cls").alias("part"))
        parts = materialize(parts, "parts")
        counted = parts.groupBy("band", "key", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
        most = F.max(F.struct("rows", "n", "part"))
        mixed = counted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), most.alias("most")).where("parts > 1")

        def blocks(rows: str, n: str) -> Column:
            return F.expr(f"cast(greatest(ceil(({rows}) / {_BLOCK}), ceil(({n}) / {_ELEMENTS})) as int)")

        mixed = mixed.select("band", "key", F.col("most.part").alias("largest"), blocks("rows", "n").alias("j_all"), blocks("rows - most.rows", "n - most.n").alias("i_all"))
        apart = materialize(parts.join(materialize(mixed, "mixed-buckets"), ["band", "key"]), "apart")
        rows = apart.join(self.sets, "cls")
        draw = F.xxhash64("cls", F.lit(5))
        cols = ["band", "key", "i", "j", "side", "cls", "part", "elements"]
        one = rows.where("part <> largest").withColumn("i", F.pmod(draw, F.col("i_all")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("j_all") - 1))).withColumn("side", F.lit(0))
        two = rows.withColumn("j", F.pmod(draw, F.col("j_all")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_all") - 1))).withColumn("side", F.lit(1))
        both = one.select(*cols).union(two.select(*cols))
        return both.groupBy("band", "key", "i", "j").applyInArrow(_between(self.percent), "a binary, b binary")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are alike enough."""
        one = self.sets.select(F.col("cls").alias("a"), F.col("elements").alias("ea"))
        two = self.sets.select(F.col("cls").alias("b"), F.col("elements").alias("eb"))
        both = pairs.join(one, "a").join(two, "b")
        common = F.size(F.array_intersect("ea", "eb"))
        total = F.size("ea") + F.size("eb") - common
        return both.where(100 * common.cast("long") >= self.percent * total.cast("long")).select("a", "b")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80, bands: int = 26, rows: int = 5) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row: documents whose sets of ``width``-word shingles have a similarity
    of ``percent`` % or more are linked; a component is named by its smallest id, which is kept."""
    named = _Search(docs, id_col, text_col, width, percent, bands, rows).run()
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


@shielded(id_col="doc_id", text_col="text")
def drop_near_duplicates(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without documents that are not the kept one of their component."""
    id_col = str(options.get("id_col", "doc_id"))
    gone = near_duplicates(docs, **options).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
