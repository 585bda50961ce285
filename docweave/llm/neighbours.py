"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm. Vectors are
split into ranges of norms, each with its own M, so a few long vectors don't push all others together; a query visits every
range but those whose M times its own length is below its bound. Each of ``tables`` tables hashes a vector by functions
floor((a v + b) / w) with normal a; their number grows with the logarithm of the number of vectors, so buckets stay small and
the share of rows that a query meets falls. A query visits its own bucket and buckets perturbed by one step in some functions,
in the order of their estimated success: perturbation sets over the ranks of the distances to the boundaries, by expected sum
of squares. How many are visited is fitted: ``fit_queries`` queries are compared with all rows once, and the smallest number
whose buckets hold ``recall`` of their true neighbours is taken, up to ``max_probes``. Candidates of all tables are merged and
ranked by their exact inner products in double precision.

Buckets are grouped into shards of bounded size, and a shard that a common bucket makes larger is split by ids, so no task gets
more than its part; of equal vectors only the smallest ids can be among the nearest, so no more are kept than that; equal
queries are searched once. The most promising eighth of the probes is made first. The k-th best score found, or that of sampled
rows (``sample``, which the driver may hold) in buckets that the query visits anyway, is a bound: no shard need report less, and
the result is the same without.

Defined results: vectors that are null, empty, zero, of another length than the commonest, or hold null or non-finite
components take no part, nor do rows with a null id; components that are less than 2**-1022 of the largest of all may count as
zero, and scores beyond a double's range become infinite or zero after they are ranked; ties go to the smaller id; of rows repeated with the same id one counts,
always the same; up to 2 (k + 1) vectors share one bucket, so with fewer than ``k`` candidates all are returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.llm.common import materialize

#: Norms in a range differ by this factor at most; the last range holds all smaller ones.
_RATIO, _RANGES = 1.1, 64
_LEAST_PROBES = 32
#: By how much of the product of two lengths a score may fall short of a bound: far more than rounding can make it.
_SLACK = 1e-9
_VECTORS = "id long, vec binary, h1 long, h2 long, norm double"


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, from components over the row's largest, whose squares don't vanish."""
    largest = np.abs(x).max(axis=1, initial=0.0)
    return largest * np.sqrt(((x / np.where(largest > 0, largest, 1.0)[:, None]) ** 2).sum(axis=1))


def _clean(exponent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(np.ldexp(x, -exponent) + 0.0)  # no negative zeros
            digests = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in vecs]
            h = [np.array([d >> s & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64) for s in (64, 0)]
            norms = pa.array([float(_norms(x[None, :])[0]) for x in vecs], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in vecs], pa.binary()), pa.array(h[0]), pa.array(h[1]), norms], names=["id", "vec", "h1", "h2", "norm"])

    return run


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)


def perturbations(functions: int, count: int) -> np.ndarray:
    """Which of the 2 * functions boundaries, ranked by distance, each of ``count`` perturbations crosses (0 or 1), in the order
    of the expected sum of squared distances. The first crosses none; none crosses both boundaries of one function."""
    m = functions

    def expected(j: int) -> float:
        if j <= m:
            return j * (j + 1) / (4 * (m + 1) * (m + 2))
        i = 2 * m + 1 - j
        return 1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2))

    costs = [expected(j) for j in range(1, 2 * m + 1)]
    found: list[tuple[int, ...]] = [()]
    waiting = [(costs[0], (0,))] if m else []
    while waiting and len(found) < count:
        cost, chosen = heapq.heappop(waiting)
        if len({min(j, 2 * m - 1 - j) for j in chosen}) == len(chosen):
            found.append(chosen)
        last = chosen[-1] + 1
        if last < 2 * m:
            heapq.heappush(waiting, (cost - costs[last - 1] + costs[last], (*chosen[:-1], last)))
            heapq.heappush(waiting, (cost + costs[last], (*chosen, last)))
    out = np.zeros((len(found), 2 * m), np.int64)
    for i, chosen in enumerate(found):
        out[i, list(chosen)] = 1
    return out


class Hashing:
    """The hash functions of all tables and the order of perturbations."""

    def __init__(self, dim: int, largest: dict[int, float], tables: int, functions: int, width: float, most: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.normals = rng.normal(size=(dim + 1, tables * functions))
        self.shifts = rng.uniform(0, width, tables * functions)
        self.factors = rng.integers(1, 1 << 62, functions) * 2 + 1
        self.tables, self.functions, self.width, self.largest = tables, functions, width, largest
        self.crossed = perturbations(functions, most)

    def places(self, x: np.ndarray, ranges: np.ndarray | None = None) -> np.ndarray:
        """Projections (rows, tables, functions) in units of the bucket width. Queries have no ranges and are taken at length 1."""
        norms = _norms(x)[:, None]
        if ranges is None:
            x, rest = x / np.where(norms > 0, norms, 1.0), np.zeros((len(x), 1))
        else:
            largest = np.array([self.largest[r] or 1.0 for r in ranges.tolist()])[:, None]
            x = x / largest
            rest = np.sqrt(np.maximum(0, 1 - (norms / largest) ** 2))
        p = (np.hstack([x, rest]) @ self.normals + self.shifts) / self.width
        return p.reshape(len(x), self.tables, self.functions)

    def keys(self, places: np.ndarray) -> np.ndarray:
        """One long for the cells of the last axis; sums wrap."""
        return (np.floor(places).astype(np.int64) * self.factors).sum(axis=-1)

    def probes(self, places: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Keys (rows, tables, stop - start) of the buckets to visit, most promising first."""
        below = places - np.floor(places)
        by = np.argsort(np.concatenate([below, 1 - below], axis=-1), axis=-1, kind="stable")
        steps = np.concatenate([-self.factors, self.factors])[by]
        return self.keys(places)[..., None] + steps @ self.crossed[start:stop].T


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int32)


def _index(hashing: Hashing, dim: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), dim)
            ranges = batch.column(2).to_numpy()
            keys = hashing.keys(hashing.places(x, ranges)).reshape(-1)
            rows = pa.array(np.repeat(np.arange(len(x)), hashing.tables))
            t = ranges[:, None] * hashing.tables + np.arange(hashing.tables)
            yield pa.RecordBatch.from_arrays([pa.array(t.reshape(-1).astype(np.int32)), pa.array(_shard(keys, shards)), pa.array(keys), batch.column(0).take(rows), batch.column(1).take(rows)], names=["t", "shard", "b", "id", "vec"])

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order wherever it is computed, so that a pair has one score."""
    return np.einsum("id,id->i", q, x, optimize=False)


def _nearest_of_all(held: object, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each batch for the few queries held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = held.value
        queries = _matrix(raw, dim)
        for batch in batches:
            x, ids = _matrix(batch.column(1).to_pylist(), dim), batch.column(0).to_numpy()
            scores = queries @ x.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            row = best.reshape(-1)
            q = np.repeat(np.array(names, np.int64), best.shape[1])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[row]), pa.array(np.take_along_axis(scores, best, 1).reshape(-1)), batch.column(1).take(at), batch.column(2).take(at)], names=["q", "id", "score", "vec", "range"])

    return run


def fitted_probes(hashing: Hashing, clean: DataFrame, asked: DataFrame, *, dim: int, k: int, fit_queries: int, recall: float, seed: int) -> int:
    """The smallest number of probes, ``_LEAST_PROBES`` at least, that finds ``recall`` of the true neighbours of a few queries; they are compared with all
    rows in tasks, and only their ``k`` best each reach the driver."""
    most = len(hashing.crossed)
    few = asked.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(fit_queries).collect()
    names, raw = [r["id"] for r in few], [bytes(r["vec"]) for r in few]
    held = clean.sparkSession.sparkContext.broadcast((names, raw))
    near = clean.select("id", "vec", "range").mapInArrow(_nearest_of_all(held, dim, k + 1), "q long, id long, score double, vec binary, range int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    true = near.where("q <> id").withColumn("place", place).where(F.col("place") <= k).select("q", "vec", "range").collect()
    if not true:
        return most
    at = {q: i for i, q in enumerate(names)}
    own = np.array([at[r["q"]] for r in true])
    probes = hashing.probes(hashing.places(_matrix(raw, dim)), 0, most)
    keys = hashing.keys(hashing.places(_matrix([bytes(r["vec"]) for r in true], dim), np.array([r["range"] for r in true])))
    first = np.full(len(true), most)
    for i, q in enumerate(own.tolist()):
        for t in range(hashing.tables):
            hit = np.flatnonzero(probes[q, t] == keys[i, t])
            if len(hit):
                first[i] = min(first[i], hit[0])
    return min(most, max(_LEAST_PROBES, int(np.sort(first)[int(np.ceil(recall * len(first))) - 1]) + 1))


def _sample_bounds(hashing: Hashing, dim: int, count: int, held: object, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k-th best score of each query among sampled rows in the buckets that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sample_ranges = held.value
        sample = _matrix(raw, dim)
        sample_keys = hashing.keys(hashing.places(sample, sample_ranges))
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                x = _matrix(batch.column(1).to_pylist(), dim)
                keys = hashing.probes(hashing.places(x), 0, count)
                bounds = np.full(len(x), -np.inf)
                for i in range(len(x)):
                    met = np.zeros(len(sample), bool)
                    for t in range(hashing.tables):
                        met |= np.isin(sample_keys[:, t], keys[i, t])
                    if met.sum() >= k:
                        bounds[i] = np.partition(sample[met] @ x[i], -k)[-k]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds)], names=["q", "vec", "bound"])

    return run


def _probe(hashing: Hashing, dim: int, start: int, stop: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each query and each shard that holds buckets of its probes from ``start`` to ``stop``: those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch = whole.slice(a, 64)
                x, bounds = _matrix(batch.column(1).to_pylist(), dim), batch.column(2).to_numpy()
                keys = hashing.probes(hashing.places(x), start, stop)
                norms = _norms(x)
                slack = _SLACK * norms * max(hashing.largest.values())
                # buckets by shard, the same for every range of norms
                flat = keys.reshape(len(x), -1)
                t = np.tile(np.repeat(np.arange(hashing.tables), keys.shape[2]), len(x))
                q = np.repeat(np.arange(len(x)), flat.shape[1])
                flat = flat.reshape(-1)
                shard = _shard(flat, shards)
                by = np.lexsort((shard, t, q))
                q, t, shard, flat = q[by], t[by], shard[by], flat[by]
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (t[1:] != t[:-1]) | (shard[1:] != shard[:-1])
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(q)).astype(np.int32)), pa.array(flat))
                for r, largest in hashing.largest.items():
                    wanted = np.flatnonzero((norms * largest >= bounds - slack)[q[first]])
                    rows = pa.array(q[first[wanted]])
                    yield pa.RecordBatch.from_arrays([pa.array((r * hashing.tables + t[first[wanted]]).astype(np.int32)), pa.array(shard[first[wanted]]), *(batch.column(c).take(rows) for c in range(3)), lists.take(pa.array(wanted))], names=["t", "shard", "q", "vec", "bound", "buckets"])

    return run


def _rank_shard(dim: int, k: int, longest: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found_q, found_x = [], []
        if queries.num_rows and rows.num_rows:
            queries, rows = queries.combine_chunks(), rows.combine_chunks()
            by = np.argsort(rows.column("b").to_numpy(), kind="stable")
            b = rows.column("b").to_numpy()[by]
            ids = rows.column("id").to_numpy()[by]
            x = _matrix(rows.column("vec").to_pylist(), dim)[by]
            q = _matrix(queries.column("vec").to_pylist(), dim)
            bounds = queries.column("bound").to_numpy() - _SLACK * _norms(q) * longest
            own, first, n = np.unique(b, return_index=True, return_counts=True)
            lists = queries.column("buckets").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            asked = lists.flatten().to_numpy()
            asker = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            held = own[at] == asked
            at, asker = at[held], asker[held]
            order = np.argsort(at, kind="stable")
            at, asker = at[order], asker[order]
            visited, start = np.unique(at, return_index=True)
            for bucket, lo, hi in zip(visited.tolist(), start.tolist(), [*start[1:].tolist(), len(at)][: len(start)], strict=True):
                who = asker[lo:hi]
                a = int(first[bucket])
                rough = q[who] @ x[a : a + int(n[bucket])].T
                i, j = np.nonzero(rough >= bounds[who, None])
                if len(i):
                    found_q.append(who[i])
                    found_x.append(j + a)
        if not found_q:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        fq, fx = np.concatenate(found_q), np.concatenate(found_x)
        score = np.concatenate([_scores(q[fq[c : c + 65536]], x[fx[c : c + 65536]]) for c in range(0, len(fq), 65536)])
        order = np.lexsort((ids[fx], -score, fq))
        fq, fx, score = fq[order], fx[order], score[order]
        edge = np.flatnonzero(np.append(True, fq[1:] != fq[:-1]))
        best = np.arange(len(fq)) - np.repeat(edge, np.diff(np.append(edge, len(fq)))) < k
        return pa.table({"q": queries.column("q").to_numpy()[fq[best]], "id": ids[fx[best]], "score": score[best]})

    return run


def _smallest_of_equals(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k with the smallest ids, in two steps so that a very common vector is spread over tasks first."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["h1", "h2", "salt"], ["h1", "h2"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= k)
    return salted.drop("salt", "place")


def nearest(
    vectors: DataFrame,
    *,
    queries: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    tables: int = 8,
    width: float = 3.0,
    recall: float = 0.95,
    max_probes: int = 2048,
    fit_queries: int = 64,
    shard_rows: int = 4096,
    sample: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found of each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    sizes = vectors.where(F.col(id_col).isNotNull()).groupBy(F.size(vector_col).alias("size")).count().where("size > 0")
    commonest = sizes.orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if commonest is None:
        return empty
    dim = commonest["size"]
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) == dim) & ~F.exists(vector_col, lambda x: x.isNull())
    chosen = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    marked = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    one = F.min(F.struct("h1", "h2", "norm", "vec")).alias("one")
    # a power of two takes the largest component to 1/2 to 1: no product of lengths overflows, and scores are scaled back exactly
    sized = F.transform(F.col("vec").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.abs(x)).otherwise(0.0))
    exponent = math.frexp(marked.agg(F.max(F.array_max(sized))).first()[0] or 1.0)[1]
    clean = materialize(marked.mapInArrow(_clean(exponent), _VECTORS).groupBy("id").agg(one).select("id", "one.*"), "vectors")
    n, longest = clean.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not n:
        return empty
    steps = F.coalesce(F.floor((F.log(F.lit(longest)) - F.log("norm")) / float(np.log(_RATIO))), F.lit(_RANGES - 1))
    clean = clean.withColumn("range", F.least(F.lit(_RANGES - 1), F.greatest(F.lit(0), steps)).cast("int"))
    largest = {r["range"]: r["largest"] for r in clean.groupBy("range").agg(F.max("norm").alias("largest")).collect()}
    asked_ids = vectors.where(usable & chosen).select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = materialize(clean.join(asked_ids, "id", "left_semi"), "queries")
    names = materialize(asked.groupBy("h1", "h2").agg(F.min("id").alias("q")), "query-classes")
    # searched once for each distinct query vector, for one more than asked: the query itself may be among them
    distinct = asked.join(names.select("q"), asked["id"] == F.col("q"), "left_semi").select("id", "vec")
    functions = max(0, round(1.25 * float(np.log2(n / (2 * (k + 1))))))
    hashing = Hashing(dim, largest, tables if functions else 1, functions, width, max_probes, seed)
    count = fitted_probes(hashing, clean, distinct, dim=dim, k=k, fit_queries=fit_queries, recall=recall, seed=seed)
    rows = clean.select("vec", "range").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    held = spark.sparkContext.broadcast(([bytes(r["vec"]) for r in rows], np.array([r["range"] for r in rows])))
    shards = -(-n // shard_rows)
    index = _smallest_of_equals(clean, k + 1).select("id", "vec", "range").mapInArrow(_index(hashing, dim, shards), "t int, shard int, b long, id long, vec binary")
    index = materialize(index, "index")
    parts = materialize(index.groupBy("t", "shard").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).cast("int").alias("parts")), "shards")
    keys, order = ["t", "shard", "part"], [F.col("score").desc(), F.col("id").asc()]
    dealt = index.join(parts, ["t", "shard"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int")).drop("parts")

    def search(bounded: DataFrame, start: int, stop: int) -> DataFrame:
        asks = bounded.repartition(-(-n // 4096), "q").mapInArrow(_probe(hashing, dim, start, stop, shards), "t int, shard int, q long, vec binary, bound double, buckets array<long>")
        asks = asks.join(parts, ["t", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found = asks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_rank_shard(dim, k + 1, longest), "q long, id long, score double")
        merged = found.groupBy("q", "id").agg(F.max("score").alias("score"))
        return merged.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= k + 1)

    bounded = materialize(distinct.repartition(-(-n // 4096), "id").mapInArrow(_sample_bounds(hashing, dim, count, held, k + 1), "q long, vec binary, bound double"), "bounds")
    # the most promising buckets first: what they hold tells how good a row of the others must be
    early = -(-count // 8)
    top = materialize(search(bounded, 0, early), "first-found")
    if count > early:
        better = top.where(F.col("place") == k + 1).select("q", F.col("score").alias("better"))
        closer = bounded.join(better, "q", "left").select("q", "vec", F.greatest("bound", "better").alias("bound"))
        more = search(closer, early, count).union(top).groupBy("q", "id").agg(F.max("score").alias("score"))
        top = more.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= k + 1)
    per_query = asked.select("id", "h1", "h2").join(names, ["h1", "h2"]).select(F.col("id").alias("query_id"), "q")
    near = per_query.join(top.select("q", "id", "score"), "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    score = F.col("score")
    for part in (exponent // 2, exponent - exponent // 2) * 2:
        score = score * F.lit(2.0**part)
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), score.alias("score"))
