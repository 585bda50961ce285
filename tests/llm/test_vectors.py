"""Hard negatives and clustering against plain versions, on odd, tied and empty tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import clustering
from docweave.llm.clustering import cluster_vectors, nearest_centroids
from docweave.llm.negatives import Best, mine_hard_negatives, score_window
from docweave.llm.quantised import products
from docweave.session import ship

SCHEMA = "vec_id long, embedding array<double>, label int, id string, anchor string, vec string, h1 int, cluster int, score int"


def table(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    ship(spark)
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def counts(v: list | None) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows: list[tuple], k: int = 5, m: int = 10) -> set[tuple]:
    known: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is not None and label is not None and counts(v):
            q = [math.floor(256 * x) for x in v]
            known[i] = min(known.get(i, (label, np.array(q, "<i4").tobytes(), q)), (label, np.array(q, "<i4").tobytes(), q))
    out = set()
    for a, (label, _, v) in known.items():
        if a % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, _, w) in known.items() if i != a and len(w) == len(v))
        for s, p, _ in [r for r in ranked if r[2] == label][:k]:
            inside = [r for r in ranked if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:m]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside, 1)}
    return out


def odd_vectors(seed: int, n: int, dims: int, scale: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i, (scale * (rng.normal(size=dims) + 0.6)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = rows[1][1]
    rows += [(n + i, same, i % 2) for i in range(60)]
    rows += [(5000, None, 1), (5100, [1.0] * (dims - 1) + [None], 1), (5200, [math.nan] + [0.0] * (dims - 1), 2), (5300, [math.inf] + [1.0] * (dims - 1), 2)]
    rows += [(5400, same, None), (None, same, 1), (5500, [], 1), (5501, [], 2), (5502, [], 1), (-100, same, 0), (5600, [0.0] * dims, 1)]
    return [*rows, rows[0], rows[7], (100, [1.0] * dims, 3), (5700, [2.0] * (dims + 3), 1), (5701, [2.0] * (dims + 3), 1), (5702, [1.0] * (dims + 3), 0)]


@pytest.mark.parametrize(("dims", "scale", "block_bytes"), [(8, 1.0, 16 << 20), (8, 1.0, 300), (5, 900_000.0, 700)])
def test_hard_negatives(spark, dims, scale, block_bytes):
    rows = odd_vectors(dims, 330, dims, scale)
    found = mine_hard_negatives(table(spark, rows), anchors=F.col("vec_id") % 100 == 0, block_bytes=block_bytes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = plain_negatives(rows)
    assert len(wanted) > 50
    assert Counter(map(tuple, found.collect())) == Counter(wanted)


def test_hard_negatives_of_nothing(spark):
    empty = mine_hard_negatives(table(spark, []), anchors=F.col("vec_id") % 100 == 0)
    assert empty.collect() == []
    none_asked = mine_hard_negatives(table(spark, odd_vectors(1, 20, 4)), anchors=F.lit(None).cast("boolean"))
    assert none_asked.collect() == [] and none_asked.columns == empty.columns


def test_vectors_too_large_for_a_long_take_no_part(spark):
    rows = [(0, [1e300, 1.0], 1), (1, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (2, [0.5, 0.5], 2)]
    found = mine_hard_negatives(table(spark, rows), anchors=F.col("vec_id") % 100 == 0).collect()
    assert {(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in found} == {(100, 1, 2)}


def test_windows_are_exact():
    for p in [0, 1, 7, 99, 10**17 + 3, -5]:
        low, high = score_window(p, 30, 90)
        for s in {low - 1, low, high, high + 1}:
            assert (low <= s <= high) == (30 * p <= 100 * s <= 90 * p)


def test_best_keeps_ties_by_id():
    best = Best(2, 3)
    for part in np.array_split(np.random.default_rng(2).permutation(40), 5):
        best.consider(np.array([0, 1]), np.array([[5.0] * len(part), list(part % 4)]), part)
    assert best.ids.tolist() == [[0, 1, 2], [3, 7, 11]] and best.scores[1].tolist() == [3, 3, 3]


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in [100, 1 << 27]:
        a, b = (rng.integers(-top, top, (4, 64)).astype(np.int32) for _ in range(2))
        assert products(a, b).astype(object).tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def plain_clusters(rows: list[tuple], dims: int, k: int, rounds: int) -> Counter:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if counts(v) and len(v) == dims]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    centroids = [v for _, _, v in starts[:k]]

    def nearest(v: list[int]) -> tuple[int, int]:
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = Counter()
    for _, d, j in found:
        of[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, of[j], sum(of.values()), shas[j]) for i, d, j in found)


@pytest.mark.parametrize(("n", "dims", "k", "scale"), [(300, 8, 6, 1.0), (40, 5, 16, 1.0), (3, 4, 16, 1.0), (200, 8, 5, 300_000.0)])
def test_clusters(spark, n, dims, k, scale, monkeypatch):
    rows = odd_vectors(n, n, dims, scale) if n > 10 else [(i, [float(i)] * dims, 0) for i in range(n)]
    rows += [(9000 + i, rows[1][1], 0) for i in range(90)]  # one vector that a third of the rows share
    monkeypatch.setattr(clustering, "_LEAST_COMMON", 20)
    found = cluster_vectors(table(spark, rows), dims=dims, k=k)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    wanted = plain_clusters(rows, dims, k, 3)
    assert Counter(map(tuple, found.collect())) == wanted
    assert Counter(map(tuple, cluster_vectors(table(spark, rows, 7), dims=dims, k=k).collect())) == wanted


def test_clusters_of_nothing(spark):
    empty = cluster_vectors(table(spark, []))
    assert empty.collect() == []
    short = cluster_vectors(table(spark, [(1, [1.0, 2.0], 0), (2, None, 0)]))
    assert short.collect() == [] and short.dtypes == empty.dtypes == cluster_vectors(table(spark, [(1, [0.1] * 64, 0)])).dtypes


def test_nearest_centroid_ties_go_to_the_smaller():
    best, squared = nearest_centroids(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5]]))
    assert best.tolist() == [0, 2] and squared.tolist() == [1, 0]
