"""Mixing, packing, nearest neighbours, quotation linking, pseudonyms and the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.chat import link_quotes
from docweave.llm.mixing import mix_sources, mixed_documents
from docweave.llm.neighbours import Hashing, nearest, perturbations
from docweave.llm.packing import about_pieces, fill_window, pack_lengths, pack_pieces, tokenize_pieces
from docweave.llm.pii import KINDS, feistel, luhn_digit, pseudonymize, pseudonyms
from tests.llm import brute
from tests.llm.conftest import DATA, pairs_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
KEY = b"a key of the tests"


def wanted_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Water filling by hand: whoever is above the limit is set to it and the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = min(1.5 * sum(sizes.values()), 2.0 * sum(sizes.values()))
    out: dict[str | None, float] = {}
    while len(out) < len(sizes):
        left = [s for s in sizes if s not in out]
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        out |= {s: 2.0 * sizes[s] for s in over} if over else share
    return out


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    rows = mix_sources(df).collect()
    source = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    texts = dict(pairs_of(df))
    sizes, taken, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(brute.words(texts[r["doc_id"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        n[source[r["doc_id"]]] += 1
    targets = wanted_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 64 * (1 + n[s] // 256) + 0.002 * sizes[s]
    assert sorted(map(tuple, mix_sources(df.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_mixed_documents_repeat(docs):
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2


def test_mixed_documents_meet_targets(spark):
    """Whole copies keep each source's words, of targets far below and near its size, with null and repeated ids too."""
    rng = np.random.default_rng(11)
    sources = [None, *(f"s{i:02d}" for i in range(19))]
    rows = []
    for j, s in enumerate(sources):
        for _ in range(600 if j == 5 else 40):
            rows.append((None if len(rows) % 9 == 0 else len(rows), " ".join(f"w{len(rows)}" for _ in range(int(rng.integers(60, 500)))), s))
    rows += [(None, "same words here " * 30, "s07")] * 40
    rows += [(i, t + " again", s) for i, t, s in rows[:30]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes, largest, got, n = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        k = len(t.split())
        sizes[s], largest[s], n[s] = sizes[s] + k, max(largest[s], k), n[s] + 1
    options = {"percent": 60, "weights": (1.0, 2.0, 6.0)}
    numbered = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], df.schema)
    targets = {rows[r["doc_id"]][2]: r["target"] for r in mix_sources(numbered, **options).collect()}
    mixed = mixed_documents(df, **options).collect()
    for r in mixed:
        got[r["source"]] += len(r["text"].split())
    assert set(targets) == set(sizes) and min(targets[s] / sizes[s] for s in sizes) < 0.3
    for s, t in targets.items():
        assert abs(got[s] - t) <= 64 * (1 + n[s] // 256) + largest[s], (s, sizes[s], t, got[s])
    assert sorted(map(str, mixed_documents(df.repartition(3), **options).collect())) == sorted(map(str, mixed))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_packing(request, name):
    df = request.getfixturevalue(name)
    packed = pack_pieces(tokenize_pieces(df, WORD_BPE)).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in pairs_of(df):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces.pop(i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(len(r["ids"]) == 4 * r["length"] > 0 for r in own)
    assert not pieces
    for places in windows.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    if name == "docs":
        full = sum(r["length"] for r in packed)
        assert len(windows) <= 1.02 * full / 2048 + 2
    crc = tokenize_pieces(df, WORD_BPE).withColumn("crc", F.crc32("ids")).first()
    assert crc["crc"] == zlib.crc32(bytes(crc["ids"]))


def test_groups_are_sized_by_pieces(spark):
    df = spark.createDataFrame([(1, "word " * 40000), (2, None), (3, "")], "doc_id long, text string")
    pieces = tokenize_pieces(df, WORD_BPE).count()
    assert pieces <= about_pieces(df) <= 3 * pieces
    packed = pack_pieces(tokenize_pieces(df, WORD_BPE), n_rows=about_pieces(df), rows_per_group=4)
    sizes = [r["n"] for r in packed.groupBy((F.col("sequence_id") / (1 << 40)).cast("long").alias("g")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == pieces and max(sizes) <= 12


def test_fill_window_is_closest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(1, 60, 12)
        counts = {int(n): int((lengths == n).sum()) for n in set(lengths.tolist())}
        sums = {0}
        for n in lengths.tolist():
            sums |= {s + n for s in sums if s + n <= 100}
        used = fill_window(counts, sorted(counts, reverse=True), 100)
        assert all(k <= counts[n] for n, k in used) and sum(n * k for n, k in used) == max(sums)


def test_pack_lengths_places_everything():
    lengths = np.random.default_rng(4).integers(1, 2049, 500)
    sequence, offset = pack_lengths(lengths, 2048)
    for s in set(sequence.tolist()):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist() and lengths[at].sum() <= 2048


def exact_nearest(vectors: dict[int, list[float]], asked: list[int], k: int) -> dict[int, list[int]]:
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], np.float64)
    out = {}
    for q in asked:
        s = x @ np.array(vectors[q], np.float64)
        best = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q]
        out[q] = best[:k]
    return out


@pytest.mark.parametrize(("folder", "sample", "least"), [("sf0.001", 4096, 1.0), ("sf0.1", 64, 0.9)])
def test_nearest(spark, folder, sample, least):
    """Whole lists while the sample holds all vectors; a recall of 0.9 by hashing alone, with a sample that holds few."""
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    asked = [i for i in vectors if i % 20 == 0]
    want = exact_nearest(vectors, asked, 20)
    got = defaultdict(dict)
    for r in nearest(df, queries=F.col("vec_id") % 20 == 0, sample=sample).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
        assert r["score"] == pytest.approx(float(np.dot(np.array(vectors[r["query_id"]], np.float64), np.array(vectors[r["vec_id"]], np.float64))), abs=1e-12)
    assert sorted(got) == sorted(asked)
    assert all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len(set(got[q].values()) & set(want[q])) / 20 for q in asked])
    assert recall >= least


@pytest.mark.parametrize("kind", ["one long", "lognormal, over 4096"])
def test_nearest_of_uneven_norms(spark, kind):
    """Recall by hashing when lengths differ; the sample holds few."""
    rng = np.random.default_rng(6)
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    if kind == "one long":
        x[7] *= 4
    else:
        x = np.vstack([x + rng.normal(0, 0.08, x.shape) for _ in range(3)])
        x *= rng.lognormal(0, 0.5, len(x))[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    asked = [i for i in range(len(x)) if i % 60 == 0]
    want = exact_nearest(dict(enumerate(x.tolist())), asked, 20)
    got = defaultdict(set)
    for r in nearest(df, queries=F.col("vec_id") % 60 == 0, sample=64).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in asked]) >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 0.0]), (40, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, queries=F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 40, 0.5), (20, 1, 0, 1.0), (20, 2, 40, 0.5), (40, 1, 0, 0.5), (40, 2, 20, 0.5)]
    assert nearest(df.limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 1, "user", "Shall we meet on Monday?\n\nI have time at noon."),
        (1, 2, "assistant", "On Sunday, A wrote:\n> Shall we  meet on MONDAY?\n\nYes, gladly."),
        (1, 3, "user", "> > Shall we meet on Monday?\n>\n> Yes, gladly.\n\nGood, until then."),
        (2, 1, "user", "> Good, until then.\n\nI heard of this elsewhere."),
        (3, 1, None, None),
        (4, 1, "user", "> a passage found nowhere\n> ***\nnew"),
        (None, 1, "user", "> Yes, gladly.\nlost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert [(got[k]["reply_conv"], got[k]["reply_turn"]) for k in [(1, 1), (1, 2), (1, 3), (2, 1), (4, 1)]] == [(None, None), (1, 1), (1, 2), (1, 3), (None, None)]
    assert got[1, 3]["n_quotes"] == 2 and got[1, 3]["n_linked"] == 2 and got[1, 3]["text"] == "Good, until then."
    assert got[1, 2]["text"] == "Yes, gladly." and got[1, 2]["chat"] == "<|assistant|>\nYes, gladly.\n<|end|>"
    assert {got[k]["thread_id"] for k in [(1, 1), (1, 2), (1, 3), (2, 1)]} == {1} and got[4, 1]["thread_id"] == 4
    assert link_quotes(df.limit(0)).count() == 0


def test_quotes_against_plain(spark):
    """Nested quotes of earlier and later messages, ties and a passage that most messages hold, over many conversations."""
    rng = np.random.default_rng(4)
    said = [f"This is saying number {i}, and it goes on." for i in range(60)]
    rows, texts = [], []
    for c in range(40):
        for t in range(1, 1 + int(rng.integers(1, 30))):
            parts = ["Kind regards"] if rng.random() < 0.6 else []
            for _ in range(int(rng.integers(0, 4))):
                body = texts[int(rng.integers(0, len(texts)))] if texts and rng.random() < 0.7 else said[int(rng.integers(0, 60))]
                parts += ["On Sunday, A wrote:"] * int(rng.random() < 0.3) + [("> " if rng.random() < 0.5 else ">") + x for x in body.split("\n")]
                parts += [""] * int(rng.random() < 0.5) + [said[int(rng.integers(0, 60))]] * int(rng.random() < 0.7)
            text = "\n".join(parts) if parts else None
            rows.append((c, t, "user", text))
            texts.append(text or "")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], (r["reply_conv"], r["reply_turn"]) if r["reply_conv"] is not None else None, r["thread_id"], r["position"]) for r in link_quotes(df).collect()}
    want = brute.link_quotes([(c, t, x) for c, t, _, x in rows])
    assert got == want and sum(w[1] for w in want.values()) > 200 and any(w[2] and w[2][0] != k[0] for k, w in want.items())


def test_quotes_of_repeated_rows_and_other_columns(spark):
    rows = [(1, 1, "user", "Hello there", 5)] * 2 + [(1, 2, "user", "> Hello there\nyes", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat int")
    got = link_quotes(df).collect()
    assert sorted(r["position"] for r in got) == [1, 2, 3] and sum(r["n_linked"] for r in got) == 1 and "chat" in got[0].asDict()


def test_pseudonyms_of_long_values():
    """A long secret is permuted in chunks, whose keys depend on what came before; it can be undone."""
    rng = np.random.default_rng(2)
    body = "".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[i] for i in rng.integers(0, 62, 20_000)) + "7"
    text = f"token={body} and mail " + " ".join(f"u{i}@example.org" for i in range(3000))
    new, counts = pseudonyms(text, KEY)
    assert counts["secret"] == 1 and counts["email"] == 3000 and body not in new
    assert pseudonyms(new, KEY, undo=True)[0] == text
    twice = pseudonyms("key=" + "ab12" * 64, KEY)[0][4:]
    assert twice[:64] != twice[64:128]


def test_equal_values_stay_linked_in_every_format():
    """Equal values of one format get equal pseudonyms of that format wherever they stand."""
    for value, shape in (("2023-02-27", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("27.02.2023", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), ("123-45-6789", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ("10.20.30.40", r"[0-9]+(\.[0-9]+){3}"), ("a.b@example.org", r"[a-z]\.[a-z]@[a-z]{7}\.org")):
        one, two = pseudonyms(f"first {value} here", KEY)[0], pseudonyms(f"{value}, second", KEY)[0]
        new = one.removeprefix("first ").removesuffix(" here")
        assert two == f"{new}, second" and re.fullmatch(shape, new) and new != value


def test_share_of_rows_met_falls():
    """At the number of probes that finds nine of ten neighbours, larger tables are searched in a smaller share."""
    rng = np.random.default_rng(9)
    shares = []
    for n in (1000, 4000, 16_000):
        x = rng.normal(size=(n, 32))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        hashing = Hashing(32, {0: 1.0}, 8, round(1.25 * float(np.log2(n / 42))), 3.0, 512, 5)
        keys = hashing.keys(hashing.places(x, np.zeros(n, np.int64)))
        probes = hashing.probes(hashing.places(x[:40]), 0, 512)
        first = np.full((40, n), 10**6)
        for q in range(40):
            for t in range(8):
                order = np.argsort(probes[q, t], kind="stable")
                at = np.minimum(np.searchsorted(probes[q, t][order], keys[:, t]), len(order) - 1)
                hit = probes[q, t][order][at] == keys[:, t]
                first[q] = np.minimum(first[q], np.where(hit, order[at], 10**6))
        near = np.argsort(-(x[:40] @ x.T), axis=1)[:, 1:21]
        count = int(np.sort(np.take_along_axis(first, near, 1).reshape(-1))[int(0.9 * near.size)]) + 1
        shares.append(float((first < count).mean()))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.75 * shares[0]


def test_perturbations_cross_each_function_once():
    steps = perturbations(5, 200)
    assert not steps[0].any() and len({s.tobytes() for s in steps}) == len(steps) == 200
    assert all(not (s[j] and s[9 - j]) for s in steps for j in range(5))


def test_feistel_is_one_to_one():
    for size in (2, 7, 100, 1000):
        found = [feistel(v, size, KEY, b"x") for v in range(size)]
        assert sorted(found) == list(range(size))
        assert [feistel(v, size, KEY, b"x", undo=True) for v in found] == list(range(size))


def test_pseudonyms_round_trip_and_keep_formats():
    card = "4111 1111 1111 111" + luhn_digit("411111111111111")
    text = f"Mail jane.doe@example.org or call (212) 555-0187 on 2023-02-28; card {card}, ssn 123-45-6789, host 10.20.30.40, iban DE89 3704 0044 0532 0130 00."
    new, counts = pseudonyms(text, KEY)
    assert all(counts[k] == 1 for k in ("email", "phone", "date", "card", "ssn", "ip", "iban"))
    assert len(new) >= len(text) - 12 and pseudonyms(new, KEY, undo=True)[0] == text
    assert not any(v in new for v in ("jane.doe", card, "123-45-6789", "10.20.30.40", "0532 0130"))
    again, _ = pseudonyms(f"Once more {card}!", KEY)
    assert again.removeprefix("Once more ").rstrip("!") in new
    assert pseudonyms("no 2023-02-30 date, 4111 1111 1111 1112 no card", KEY)[1]["date"] == 0


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("card 4111111111111111 12/27", "card", "4111111111111111"),
        ("card 4111 1111 1111 1111 123 end", "card", "4111 1111 1111 1111"),
        ("42 4111111111111111", "card", "4111111111111111"),
        ("4111-1111-1111-1111-123", "card", "4111-1111-1111-1111"),
        ("DE89370400440532013000 BIC COBADEFF", "iban", "DE89370400440532013000"),
        ("DE89 3704 0044 0532 0130 00 EUR 500", "iban", "DE89 3704 0044 0532 0130 00"),
        ("DE89 3704 0044 0532 0130 00 EURos", "iban", "DE89 3704 0044 0532 0130 00"),
        ("AB12 DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"),
    ],
)
def test_pseudonyms_beside_neighbours(text, kind, value):
    new, counts = pseudonyms(text, KEY)
    assert counts[kind] == 1 and value not in new
    assert new == text.replace(value, pseudonyms(value, KEY)[0])
    assert pseudonyms(new, KEY, undo=True)[0] == text


def test_pseudonyms_of_runs_round_trip():
    rng = np.random.default_rng(8)
    for i in range(400):
        cards = [(c := "4" + "".join(map(str, rng.integers(0, 10, 14)))) + luhn_digit(c) for _ in range(2)]
        text = f"{i} {cards[0]} {int(rng.integers(0, 9999))}-{cards[1]} {i}"
        new, counts = pseudonyms(text, KEY)
        assert counts["card"] == 2 and not any(c in new for c in cards) and pseudonyms(new, KEY, undo=True)[0] == text


def test_pseudonyms_of_many_cards_in_one_run():
    text = "4111 1111 1111 1111 4227 " * 60 + "5500005555555559-abc"
    new, counts = pseudonyms(text, KEY)
    assert counts["card"] == 60 and new.endswith("-abc") and pseudonyms(new, KEY, undo=True)[0] == text


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_pseudonymize(request, name):
    df = request.getfixturevalue(name)
    rows = pseudonymize(df, KEY).collect()
    texts = dict(pairs_of(df))
    assert len(rows) == len(texts)
    for r in rows:
        if sum(r[f"n_{k}"] for k in KINDS) == 0:
            assert r["text"] == texts[r["doc_id"]]
        else:
            assert pseudonyms(r["text"], KEY, undo=True)[0] == texts[r["doc_id"]]


def test_null_ids_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(90)) + " a.b@example.org"
    rows = [(None, text, "a", 1, 2, 3), (None, text, "a", 1, 2, 3), (1, text, None, 1, 2, 3), (1, text, None, 1, 2, 3), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, start int, offset int, n_email int")
    mixed = mix_sources(df).collect()
    assert len(mixed) == 5 and sum(r["taken"] for r in mixed) > 0 and all(r["taken"] <= 2 * r["size"] for r in mixed)
    assert mixed_documents(df).columns == df.columns
    pieces = tokenize_pieces(df, WORD_BPE, carry=("doc_id", "start", "offset"), window=64)
    packed = pack_pieces(pieces, window=64)
    assert len(packed.columns) == len({c.lower() for c in packed.columns}) and "offset" in packed.columns
    got = packed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == pieces.count()
    hidden = pseudonymize(df, KEY)
    assert len(hidden.columns) == len({c.lower() for c in hidden.columns})
    assert sorted(r["n_email"] for r in hidden.collect()) == [0, 1, 1, 1, 1]


def test_neighbours_ignore_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 5, 6) for i in range(5)], "vec_id long, embedding array<double>, score int, rank int")
    got = nearest(df, queries=F.col("vec_id") == 0, k=2)
    assert [tuple(r) for r in got.orderBy("rank").select("rank", "vec_id", "score").collect()] == [(1, 1, 1.0), (2, 2, 1.0)]


def test_empty_tables(none):
    assert mix_sources(none).count() == 0
    assert pack_pieces(tokenize_pieces(none, WORD_BPE)).count() == 0
    assert pseudonymize(none, KEY).count() == 0


def test_pipeline_against_plain_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, DATA).cache()
    lines = corpus_pipeline.drop_lines(spark, kept, DATA).cache()
    assert {r["doc_id"]: r["text"] or "" for r in lines.collect()} == {i: t for i, (_, _, t) in brute.dedup_lines(pairs_of(kept)).items()}
    near = corpus_pipeline.drop_near(spark, lines, DATA).cache()
    want = brute.near_components(pairs_of(lines), 5, 80)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert kept.columns == lines.columns == near.columns == docs.columns
    ran = corpus_pipeline.run(spark, DATA).collect()
    mixed = corpus_pipeline.mix(spark, near, DATA)
    assert {r["doc_id"] for r in ran} == {r["doc_id"] for r in mixed.collect()}
    assert sum(r["length"] for r in ran if r["start"] == 0) > 0
