"""Hard negatives for contrastive training, mined by blocked matrix products.

Vectors become whole numbers floor(scale * x), so that scores (inner products) are exact integers: products are made in float64
while no sum can reach 2**53, in 64-bit integers beyond. Anchors are gathered into blocks of bounded bytes; one block at a time
is broadcast and multiplied with blocks of all rows. The first pass keeps each anchor's best rows of the same label in every
task; these lists merge, so tasks report their own and a window takes the best of them. The second pass broadcasts the block with
the score windows of its positives and keeps the best rows of other labels inside each window in the same way. What a task
keeps and reports is bounded by the block, whatever the number of rows; nothing is grouped by label, so a common label or a
common vector loads no task more than others. Each pass is a job of its own over the written rows, and its result is written.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors of d
components of which one reaches sqrt(2**62 / d) after scaling (scores would not fit a long). An anchor meets only vectors of its
own length. Of rows with one id one counts: that with the smallest label, then the smallest bytes. Equal scores go by smaller
id, equal vectors of different ids are rows of their own. An anchor without positives, or whose windows are empty (as for
negative positives), has no rows. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import materialize
from docweave.llm.quantised import matrix, packed, products, quantised

Batches = Iterator[pa.RecordBatch]

_NONE = np.iinfo(np.int64).min
#: Rows of an anchor slice and of a candidate slice, of which one matrix of scores is made at a time.
_ANCHORS, _ROWS = 512, 2048


def _whole(scale: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, lengths, ints = quantised(batch.column(3), scale)
            kept = [c.take(pa.array(at)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*kept, packed(ints, lengths)], names=["id", "label", "anchor", "vec"])

    return run


@dataclass
class AnchorBlock:
    """Anchors of one length, with the windows of their positives in the second pass (lowest and highest score, by column)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Best:
    """The best ``k`` (score, id) of each of ``n`` lists: higher scores first, ties by smaller id."""

    n: int
    k: int
    scores: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.scores = np.full((self.n, self.k), _NONE)
        self.ids = np.zeros((self.n, self.k), np.int64)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(which)
        old = np.repeat(touched, self.k), self.scores[touched].ravel(), self.ids[touched].ravel()
        real = old[1] != _NONE
        which, scores, ids = (np.concatenate([a[real], b]) for a, b in zip(old, (which, scores, ids), strict=True))
        order = np.lexsort((ids, -scores, which))
        which, scores, ids = which[order], scores[order], ids[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        top = place < self.k
        self.scores[which[top], place[top]] = scores[top]
        self.ids[which[top], place[top]] = ids[top]

    def consider(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, floor: np.ndarray | None = None) -> None:
        """Add what can matter of a matrix of scores (row i for ``lists[i]``, column j for ``ids[j]``; -inf or the smallest
        integer where the pair doesn't count)."""
        least = self.scores[lists, self.k - 1]
        if floor is not None:
            least = np.maximum(least, floor)
        least = np.maximum(least, _NONE + 1).astype(scores.dtype)
        hits = scores >= least[:, None]
        if scores.shape[1] > self.k and hits.sum() > 4 * self.k * len(lists):
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            hits &= scores >= kth[:, None]
        row, column = np.nonzero(hits)
        if len(row):
            self.add(lists[row], scores[row, column].astype(np.int64), ids[column])

    def batch(self, names: list[str], firsts: list[np.ndarray]) -> pa.RecordBatch:
        real = self.scores != _NONE
        heads = [np.repeat(f, self.k)[real.ravel()] for f in firsts]
        return pa.RecordBatch.from_arrays([*map(pa.array, heads), pa.array(self.scores[real]), pa.array(self.ids[real])], names=names)


def _slices(batches: Batches, dims: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ids, labels, vectors) of slices of the rows, ordered by label."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(2)).to_numpy() // 4
        for d in dims.intersection(sizes.tolist()):
            own = batch.filter(pa.array(sizes == d)) if (sizes != d).any() else batch
            for i in range(0, own.num_rows, _ROWS):
                part = own.slice(i, _ROWS)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                order = np.argsort(labels, kind="stable")
                yield d, ids[order], labels[order], matrix(part.column(2), d)[order]


def _impossible(kind: np.dtype) -> float | int:
    return -np.inf if kind == np.float64 else _NONE


def _positives(blocks: Broadcast, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held: dict[int, AnchorBlock] = blocks.value
        best = {d: Best(len(b.ids), k) for d, b in held.items()}
        for d, ids, labels, vectors in _slices(batches, set(held)):
            block = held[d]
            for label in np.intersect1d(block.labels, labels):
                mine = np.flatnonzero(block.labels == label)
                a, b = np.searchsorted(labels, [label, label + 1])
                for i in range(0, len(mine), _ANCHORS):
                    lists = mine[i : i + _ANCHORS]
                    scores = products(block.vectors[lists], vectors[a:b])
                    _, own, itself = np.intersect1d(block.ids[lists], ids[a:b], return_indices=True)
                    scores[own, itself] = _impossible(scores.dtype)
                    best[d].consider(lists, scores, ids[a:b])
        for d, b in best.items():
            yield b.batch(["anchor_id", "score", "id"], [held[d].ids])

    return run


def _negatives(blocks: Broadcast, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held: dict[int, AnchorBlock] = blocks.value
        n = {d: b.low.shape[1] for d, b in held.items()}
        best = {d: Best(len(b.ids) * n[d], k) for d, b in held.items()}
        for d, ids, labels, vectors in _slices(batches, set(held)):
            block = held[d]
            for i in range(0, len(block.ids), _ANCHORS):
                mine = np.arange(i, min(i + _ANCHORS, len(block.ids)))
                scores = products(block.vectors[mine], vectors)
                scores[block.labels[mine, None] == labels[None, :]] = _impossible(scores.dtype)
                for j in range(n[d]):
                    low, high = block.low[mine, j], block.high[mine, j]
                    some = np.flatnonzero(low <= high)
                    if len(some):
                        inside = scores[some]
                        inside[inside > high[some, None].astype(scores.dtype)] = _impossible(scores.dtype)
                        best[d].consider(mine[some] * n[d] + j, inside, ids, low[some])
        for d, b in best.items():
            size = len(held[d].ids)
            yield b.batch(["anchor_id", "nth", "score", "id"], [np.repeat(held[d].ids, n[d]), np.tile(np.arange(n[d], dtype=np.int32), size)])

    return run


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score (an empty range where there is none)."""
    return -(-low * score // 100), high * score // 100


def mine_hard_negatives(vectors: DataFrame, *, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``anchors`` marks and each
    of its best ``positives`` other rows of the same label, the best ``negatives`` rows of other labels whose scores lie
    between ``low`` and ``high`` percent of the positive's. ``block_bytes`` bounds what is broadcast at once."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = source.where("id is not null and label is not null and vec is not null").mapInArrow(_whole(scale), "id long, label long, anchor boolean, vec binary")
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("row"))
    # products are bound by computation: at least as many parts as there are cores
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = materialize(one.select("id", "row.label", "row.vec", "row.anchor").repartition(parts, "id"), "negatives-rows")
    asked = rows.where("anchor").select("id", "label", "vec")
    total = asked.agg(F.coalesce(F.sum(F.length("vec") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    out = f"negatives-{uuid.uuid4().hex}"
    results: list[DataFrame] = []
    for number in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == number).toArrow()
        sizes = np.array([len(v) // 4 for v in block.column("vec").to_pylist()], np.int64)
        held = {}
        for d in np.unique(sizes).tolist():
            own = block.filter(pa.array(sizes == d))
            held[d] = AnchorBlock(own.column("id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("vec"), d))
        if not held:
            continue
        sent = spark.sparkContext.broadcast(held)
        found = rows.select("id", "label", "vec").mapInArrow(_positives(sent, positives), "anchor_id long, score long, id long")
        ranked = _top(found, ["anchor_id"], positives)
        known = materialize(ranked.select("anchor_id", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), out)
        sent.unpersist()
        best = {(a, j): s for a, j, s in zip(*(c.to_pylist() for c in known.select("anchor_id", "nth", "positive_score").toArrow().columns), strict=True)}  # the block's anchors times positives at most
        for b in held.values():
            windows = np.array([[score_window(best[a, j], low, high) if (a, j) in best else (1, 0) for j in range(positives)] for a in b.ids.tolist()], np.int64)
            b.low, b.high = windows[:, :, 0], windows[:, :, 1]
        sent = spark.sparkContext.broadcast(held)
        found = rows.select("id", "label", "vec").mapInArrow(_negatives(sent, negatives), "anchor_id long, nth int, score long, id long")
        top = _top(found, ["anchor_id", "nth"], negatives)
        results.append(materialize(top.join(known, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), out))
        sent.unpersist()
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    joined = results[0]
    for more in results[1:]:
        joined = joined.unionByName(more)
    return joined
