"""Line dedup across documents with two Bloom filters.

A first pass hashes line keys. Two Bloom filters, for hashes seen once and hashes seen twice, are built per partition and
folded together: what two once-filters share, or either twice-filter holds, goes into the merged twice-filter. Filters are cut
into segments, so folding is spread over tasks and each fold reads a bounded number of rows. Only lines that the merged
twice-filter suspects are shuffled, by their whole key, for exact confirmation and the choice of the first document. The
twice-filter has a fixed largest size (``max_bits``), which bounds the broadcast; beyond it more lines are suspected and
confirmed, and results stay exact.

Defined results: a null or empty text is one empty line; rows with a null id keep all lines and hold no key; rows that share
an id count as one document, and equal rows get equal results; an empty table gives an empty result; all other columns are
carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.bloom import FOLDS, has_bits, set_bits
from docweave.llm.common import fresh_name, materialize, shielded

_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at either end, A-Z in lower case."""
    return line.strip(_STRIP).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _hash_lines(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for text in batch.column(0).to_pylist():
                keys = {k for k in map(line_key, text.split(b"\n")) if _long_enough(k, least)}
                out.append([xxhash.xxh3_64_intdigest(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.uint64())).cast(pa.list_(pa.int64()), safe=False)], names=["hashes"])

    return run


def _partial_filters(bits: int, segment_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found, counts = np.unique(values, return_counts=True)
            a, b = _probes(found, bits)
            again = (counts > 1) | has_bits(once, a) & has_bits(once, b)
            for at in (a, b):
                set_bits(twice, at[again])
                set_bits(once, at)
        part = TaskContext.get().partitionId()
        size = segment_bits // 8
        for s in range(0, bits // 8, size):
            if once[s : s + size].any():
                row = [[s // size], [part], [once[s : s + size].tobytes()], [twice[s : s + size].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary())], names=["segment", "part", "once", "twice"])

    return run


_FILTER_SCHEMA = "segment long, part long, once binary, twice binary"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for o, t in zip(pdf["once"], pdf["twice"], strict=True):
        o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "part": pdf["part"].iloc[:1], "once": [once.tobytes()], "twice": [twice.tobytes()]})


def twice_filter(hashes: DataFrame, *, max_bits: int = 1 << 28, segment_bits: int = 1 << 19) -> tuple[int, dict[int, bytes]]:
    """Number of bits and the segments of the filter of hashes seen in two or more rows. ``max_bits`` bounds what the driver
    gets and broadcasts: 32 MB."""
    n = hashes.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = segment_bits
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    filters = hashes.mapInArrow(_partial_filters(bits, segment_bits), _FILTER_SCHEMA)
    for parts in FOLDS:
        filters = filters.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("segment", "part").applyInPandas(_fold, _FILTER_SCHEMA)
    return bits, {r["segment"]: bytes(r["twice"]) for r in filters.select("segment", "twice").collect()}


def _suspect_lines(bits: int, segment_bits: int, segments: object, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for s, raw in segments.value.items():
            packed[s * segment_bits // 8 : (s + 1) * segment_bits // 8] = np.frombuffer(raw, np.uint8)

        for batch in batches:
            rows: list[int] = []
            at: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for j, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least):
                        rows.append(i)
                        at.append(j)
                        keys.append(key)
            a, b = _probes(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
            hit = np.flatnonzero(has_bits(packed, a) & has_bits(packed, b))
            row = np.asarray(rows, np.int64)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.asarray(at, np.int32)[hit]), pa.array([keys[h] for h in hit], pa.binary())], names=["__id", "__row", "__at", "__key"])

    return run


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, drops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            gone = set(drops or ())
            counts.append(len(lines))
            dropped.append(len(gone))
            texts.append(text if not gone else b"\n".join(line for j, line in enumerate(lines) if j not in gone))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names[2:], "__kept", "n_lines", "n_dropped"])


@shielded(id_col="doc_id", text_col="text")
def dedup_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 10, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, n_lines (before) and n_dropped. A line whose key has ``min_chars``
    code points and stands in two documents stays only in the one with the smallest id."""
    segment_bits = 1 << 19
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(raw).alias("__row"), raw.alias("__raw"))
    hashes = materialize(keyed.where("__id is not null").select("__raw").mapInArrow(_hash_lines(min_chars), "hashes array<long>"), "line-hashes")
    bits, segments = twice_filter(hashes, max_bits=max_bits, segment_bits=segment_bits)
    suspects_schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__at", T.IntegerType()), T.StructField("__key", T.BinaryType())])
    suspects = keyed.where("__id is not null").mapInArrow(_suspect_lines(bits, segment_bits, spark.sparkContext.broadcast(segments), min_chars), suspects_schema)
    suspects = materialize(suspects, "line-suspects")
    first = suspects.groupBy("__key").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last")
    # written first: a join of two plain reads can be split where a line is very common
    first = materialize(first, "line-firsts")
    drops = suspects.join(first, "__key").where("__id > __first").groupBy("__id", "__row").agg(F.collect_set("__at").alias("__drops"))
    own = {"n_lines", "n_dropped"}
    columns = [c for c in docs.columns if c.lower() not in own]
    row, ident = fresh_name(docs, "__row"), fresh_name(docs, "__id")
    joined = docs.select(*columns, F.col(id_col).cast("long").alias(ident), F.xxhash64(raw).alias(row)).join(drops.withColumnsRenamed({"__id": "__drop_id", "__row": "__drop_row"}), (F.col(ident) == F.col("__drop_id")) & (F.col(row) == F.col("__drop_row")), "left")
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("__kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    carried = [c for c in columns if c != text_col]
    order = [docs.schema[c] for c in carried] + schema.fields[len(columns) :]
    done = joined.select(F.col(text_col).cast("binary").alias("__raw"), "__drops", *carried).mapInArrow(_drop_lines, T.StructType(order))
    return done.select(*(F.col("__kept").alias(c) if c == text_col else F.col(c) for c in columns), "n_lines", "n_dropped")
