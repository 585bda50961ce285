"""Centroid clustering of vectors in whole numbers, on distinct vectors with multiplicities.

Components become floor(scale * x). Equal vectors are grouped first (a hash aggregation, combined before the shuffle), and
Lloyd's rounds run on distinct vectors only: each task keeps one weighted integer sum a centroid and component, the sums of all
tasks are added by Spark, and the k new centroids come to the driver (k rows). Sums of integers don't depend on their order, so
reruns and other partitions give the same centroids. At the end assignments are joined back to the rows by the 128-bit names of
their vectors. Vectors that many rows share (more than a ten-thousandth of all rows, so there are 10,000 of them at most) are
joined by a broadcast, all others by a shuffle in which no key holds more than that share.

Defined results: a vector takes part if it has exactly ``dims`` components, none null or non-finite, and none of 2**27 or more
in size after scaling (squared distances would not fit a long); other rows are not returned. Repeated rows and ids are rows of
their own; a null id takes part but starts no centroid. Ties of the starting hashes go by the vectors' bytes, ties of distances
to the smaller centroid; a centroid without vectors stays; fewer than k vectors give as many centroids; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize
from docweave.llm.quantised import matrix, packed, products, quantised

#: Vectors of more than one in so many rows are common; there can't be more of them than this.
_SHARES = 10_000
_LEAST_COMMON = 64

Batches = Iterator[pa.RecordBatch]


def _cells(dims: int, scale: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, lengths, ints = quantised(batch.column(1), scale, spread=2)
            right = lengths == dims
            vecs = packed(ints[np.repeat(right, lengths)], lengths[right])
            names = [xxhash.xxh3_128_intdigest(v) for v in vecs.to_pylist()]
            h = [pa.array(np.array([n >> s & (1 << 64) - 1 for n in names], np.uint64).view(np.int64)) for s in (64, 0)]
            ids = batch.column(0).take(pa.array(at[right]))
            yield pa.RecordBatch.from_arrays([ids, *h, vecs], names=["id", "h1", "h2", "vec"])

    return run


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid (ties: the smaller) and the squared distance, exactly."""
    x, c = vectors.astype(np.int64), centroids.astype(np.int64)
    cross = products(x, c)
    size = (x * x).sum(1)[:, None], (c * c).sum(1)[None, :]
    squared = size[0] + size[1] - 2 * cross.astype(np.int64)
    best = squared.argmin(1)
    return best, squared[np.arange(len(x)), best]


def _sums(centroids: np.ndarray, dims: int) -> Callable[[Batches], Batches]:
    """Weighted sums of the vectors nearest to each centroid, one row a centroid and task."""

    def run(batches: Batches) -> Batches:
        total = np.zeros((len(centroids), dims), np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, weight = matrix(batch.column(0), dims), batch.column(1).to_numpy()
                best, _ = nearest_centroids(x, centroids)
                np.add.at(count, best, weight)
                for c in np.unique(best):
                    own = best == c
                    total[c] += (x[own].astype(np.int64) * weight[own, None]).sum(0)
        filled = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(filled) + 1) * dims, pa.int32()), pa.array(total[filled].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(count[filled]), sums], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray, dims: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            best, squared = nearest_centroids(matrix(batch.column(3), dims), centroids) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best.astype(np.int32)), pa.array(squared)], names=["h1", "h2", "weight", "cluster", "distance"])

    return run


def move_centroids(distinct: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """One round: centroids become the exact floors of their vectors' weighted means; empty ones stay."""
    parts = distinct.select("vec", "weight").mapInArrow(_sums(centroids, dims), "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    moved = centroids.copy()
    for row in added.collect():  # k rows at most
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return moved


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Centroids start as the k vectors whose ids have the smallest sha256 of ``<seed>:<id>``."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = materialize(source.mapInArrow(_cells(dims, scale), f"id {source.schema['id'].dataType.simpleString()}, h1 long, h2 long, vec binary"), "cluster-rows")
    hashed = rows.where("id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    chosen = hashed.orderBy("hash", "vec").select("vec").limit(k).collect()
    if not chosen:
        return spark.createDataFrame([], f"{id_col} {rows.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = matrix([bytes(r["vec"]) for r in chosen], dims).astype(np.int64)
    distinct = materialize(rows.groupBy("h1", "h2", "vec").agg(F.count(F.lit(1)).alias("weight")), "cluster-vectors")
    for _ in range(rounds):
        centroids = move_centroids(distinct, centroids, dims)
    columns = distinct.select("h1", "h2", "weight", "vec")
    assigned = materialize(columns.mapInArrow(_assign(centroids, dims), "h1 long, h2 long, weight long, cluster int, distance long"), "cluster-assigned")
    wide = "decimal(38,0)"
    spread = F.sum(F.col("weight").cast("decimal(18,0)") * F.col("distance").cast("decimal(19,0)")).cast(wide)
    found = {r["cluster"]: (r["rows"], int(r["spread"])) for r in assigned.groupBy("cluster").agg(F.sum("weight").alias("rows"), spread.alias("spread")).collect()}
    n_rows = sum(n for n, _ in found.values())
    inertia = [found.get(c, (0, 0))[1] for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    limit = max(_LEAST_COMMON, -(-n_rows // _SHARES))
    result = assigned.select("h1", "h2", "cluster", "distance")
    common = F.broadcast(assigned.where(F.col("weight") > limit).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "cluster", "distance"))
    named = rows.select("id", "h1", "h2").join(common, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").drop("c1", "c2")
    rest = named.where("cluster is null").select("id", "h1", "h2").join(result, ["h1", "h2"]).select("id", "cluster", "distance")
    joined = named.where("cluster is not null").select("id", "cluster", "distance").unionByName(rest)

    def of_cluster(values: list, kind: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    fits = [v if v < 1 << 63 else None for v in [*inertia, sum(inertia)]]  # beyond a long: null
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", of_cluster(fits[:-1], "long").alias("cluster_inertia"), F.lit(fits[-1]).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"))
