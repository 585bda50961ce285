"""Best-fit packing: places of all pieces, dominance without loss, best fit on counts, odd and empty tables."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.bestfit import Places, best_fit, pack_best_fit, plan_sequences, reduce_instance
from docweave.llm.packing import tokenize_pieces
from docweave.llm.queries import QUERIES
from docweave.session import ship
from tests.llm.conftest import DATA, pairs_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes: tuple[int, ...], window: int) -> int:
    """The least number of windows, by search over subsets."""

    @lru_cache(maxsize=None)
    def need(left: int) -> tuple[int, int]:  # windows begun, and the least that the last one holds
        if not left:
            return (0, window)
        options = []
        for i, n in enumerate(sizes):
            if left >> i & 1:
                used, last = need(left & ~(1 << i))
                options.append((used, last + n) if last + n <= window else (used + 1, n))
        return min(options)

    return need((1 << len(sizes)) - 1)[0]


def plain_best_fit(sizes: list[int], window: int) -> Counter:
    bins: list[list[int]] = []
    for n in sorted(sizes, reverse=True):
        open_bins = [b for b in bins if sum(b) + n <= window]
        if open_bins:
            max(open_bins, key=sum).append(n)
        else:
            bins.append([n])
    return Counter(map(sum, bins))


def totals(plan: list) -> Counter:
    out: Counter = Counter()
    for holds, many in plan:
        for n, k in holds:
            out[n] += k * many
    return Counter({n: c for n, c in out.items() if c})


@pytest.mark.parametrize("seed", range(60))
def test_reduction_loses_no_optimum(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(10, 40))
    low = int(rng.choice([1, window // 5, window // 4, window // 3]))
    sizes = tuple(rng.integers(max(1, low), window + 1, 11).tolist())
    fixed, left = reduce_instance(dict(Counter(sizes)), window)
    assert all(sum(n * k for n, k in holds) <= window and sum(k for _, k in holds) <= 3 for holds, _ in fixed)
    rest = tuple(n for n, c in left.items() for _ in range(c))
    assert totals(fixed) + Counter(left) == Counter(sizes)
    assert sum(m for _, m in fixed) + fewest(rest, window) == fewest(sizes, window)
    plan = plan_sequences(dict(Counter(sizes)), window)
    assert sum(m for _, m in plan) <= fewest(sizes, window) + 1


def test_reduction_fixes_something_of_each_kind():
    assert reduce_instance({9: 2, 5: 2}, 10)[0] == [(((9, 1),), 2), (((5, 2),), 1)]
    assert reduce_instance({7: 4, 3: 3}, 10)[0][0] == (((7, 1), (3, 1)), 3)
    triple, left = reduce_instance({10: 1, 5: 1, 4: 1}, 20)
    assert triple == [(((10, 1), (5, 1), (4, 1)), 1)] and not left


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_on_counts_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(20, 200))
    sizes = rng.integers(1, window + 1, int(rng.integers(1, 400))).tolist() + [int(rng.integers(1, window))] * 150
    plan = best_fit(dict(Counter(sizes)), window)
    assert totals(plan) == Counter(sizes)
    filled: Counter = Counter()
    for holds, many in plan:
        filled[sum(n * k for n, k in holds)] += many
    assert filled == plain_best_fit(sizes, window)


def test_places_are_gapless():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 100, 3000)
    sizes[:900] = 7
    places = Places(plan_sequences({int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True), strict=True)}, 100))
    nth, seen = [], Counter()
    for n in sizes.tolist():
        nth.append(seen[n])
        seen[n] += 1
    sequence, offset = places.find(sizes, np.array(nth))
    check_places(list(zip(sequence.tolist(), offset.tolist(), sizes.tolist(), strict=True)), 100)


def check_places(places: list[tuple[int, int, int]], window: int) -> None:
    held = defaultdict(list)
    for sequence, offset, length in places:
        held[sequence].append((offset, length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= window


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing_of_texts(request, name):
    df = request.getfixturevalue(name)
    rows = pack_best_fit(tokenize_pieces(df, WORD_BPE, window=4096)).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    for i, t in pairs_of(df):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(own.pop(i), key=lambda r: r["start"])
        assert [r["length"] for r in mine] == [min(4096, len(ids) - s) for s in range(0, len(ids), 4096)]
        assert b"".join(bytes(r["ids"]) for r in mine) == np.array(ids, "<u4").tobytes()
    assert not own
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 4096)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 2


def test_query_follows_its_contract(spark):
    rows = QUERIES["op11_best_fit_packing"](spark, DATA).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["start"] == 4096 * r["piece"] and len(piece) == min(4096, len(ids) - r["start"]) and zlib.crc32(piece.tobytes()) == r["ids_crc32"]


def test_repeated_rows_clashing_names_and_nothing(spark):
    ship(spark)
    schema = "length long, task string, nth string, size string, c0_ string, SEQUENCE_ID long, start long"
    rows = [(7, "a", "b", "c", "d", 5, None)] * 500 + [(100, None, None, None, None, None, 1)] * 20 + [(n, "x", "y", "z", "w", 0, 0) for n in range(1, 101)]
    df = spark.createDataFrame(rows, schema).repartition(6)
    found = pack_best_fit(df, window=100)
    assert found.columns == ["length", "task", "nth", "size", "c0_", "start", "sequence_id", "offset"]
    got = found.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((*r[:5], r[6]) for r in rows)
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 100)
    assert {r["sequence_id"] for r in got} == set(range(len({r["sequence_id"] for r in got})))
    assert pack_best_fit(df.limit(0), window=100).collect() == []
    with pytest.raises(ValueError):
        pack_best_fit(df.withColumn("length", F.lit(101)), window=100)
