"""Token counts, quality rules, line dedup, near-dedup and repeat removal against plain versions."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.lines import dedup_lines, twice_filter
from docweave.llm.minhash import drop_near_duplicates, near_duplicates
from docweave.llm.quality import COMMON_WORDS, good_documents, quality_rules
from docweave.llm.repeats import remove_repeats
from docweave.llm.token_counts import count_tokens
from tests.llm import brute
from tests.llm.conftest import pairs_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_token_counts(request, name):
    df = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs_of(df)}
    rows = count_tokens(df, BYTE_BPE).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == want
    assert len(rows) == len(want) and all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_rules(request, name):
    df = request.getfixturevalue(name)
    rows = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for i, t in pairs_of(df):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_metrics(t), i
    three = [(r["doc_id"], r["text"], r["lang"]) for r in df.select("doc_id", "text", "lang").collect()]
    want = brute.quality(three, COMMON_WORDS, {"chars": 400, "classes": 0.5, "words": 150, "common": 0.62})
    assert {i: r["kept"] for i, r in rows.items()} == want
    kept = good_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, k in want.items() if k)


def test_quality_keeps_clean_documents(docs):
    labelled = docs.sparkSession.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    judged = quality_rules(docs).where("not base_failed").join(labelled, "doc_id")
    assert judged.where("not kept").count() == 0


def test_strict_rules_reject_junk_of_each_kind(spark):
    from docweave.llm.queries import QUERIES
    from docweave.llm.quality import STRICT, language_references

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    judged = QUERIES["op6_quality_rules"](spark, folder).where("not base_failed").join(good.select("doc_id"), "doc_id")
    assert judged.where("not kept").count() <= 0.01 * judged.count()
    common = {w for words in COMMON_WORDS.values() for w in words}
    rows = []
    for r in good.where("n_chars > 2500 and lang in ('en', 'fr', 'de', 'es')").orderBy("doc_id").limit(60).collect():
        words = r["text"].split(" ")
        salad = " ".join(w for w in r["text"].split() if w not in common)
        wrong = {"en": "de", "de": "en", "fr": "en", "es": "de"}[r["lang"]]
        rows += [("good", r["text"], r["lang"]), ("salad", salad, r["lang"]), ("symbols", " ".join(w + "&#%"[i % 3] * 3 for i, w in enumerate(words)), r["lang"]), ("wrong", r["text"], wrong)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, kind string, text string, lang string")
    kept = {r["kind"]: (r["n"], r["k"]) for r in quality_rules(df, references=language_references(docs), **STRICT).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert len(kept) == 4 and kept["good"][1] == kept["good"][0] > 20
    assert all(kept[k][1] == 0 for k in ("salad", "symbols", "wrong")), kept


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_line_dedup(request, name):
    df = request.getfixturevalue(name)
    done = dedup_lines(df)
    assert done.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in done.collect()} == brute.dedup_lines(pairs_of(df))


def test_line_dedup_with_a_full_filter(docs):
    """A filter far too small for the lines lets all through; results stay the same."""
    done = dedup_lines(docs, max_bits=1 << 19)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in done.collect()} == brute.dedup_lines(pairs_of(docs))


def test_twice_filter_misses_nothing(spark):
    rows = [([i, i + 1],) for i in range(0, 4000, 1)]
    bits, segments = twice_filter(spark.createDataFrame(rows, "hashes array<long>").repartition(5))
    assert bits >= 16 * 8000 and sum(bin(b).count("1") for s in segments.values() for b in s) > 0


@pytest.mark.parametrize(("name", "width", "percent"), [("docs", 3, 85), ("docs", 5, 80), ("odd", 3, 85)])
def test_near_duplicates(request, name, width, percent):
    df = request.getfixturevalue(name)
    want = brute.near_components(pairs_of(df), width, percent)
    rows = near_duplicates(df, width=width, percent=percent).collect()
    assert len(rows) == len(want)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_large_group_of_near_copies(spark):
    """A bucket over the size up to which all pairs are tried."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:k] + [f"new{k}x{j}"] + base[k + 1 :]) for k in range(0, 120, 2) for j in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width=3, percent=85).collect()}
    assert got == brute.near_components(list(enumerate(texts)), 3, 85)


def test_id_on_two_texts_has_the_links_of_both(spark):
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join(f"other{i}" for i in range(60))
    rows = [(5, one), (5, two), (7, one + " more"), (2, two + " more"), (9, "alone here")]
    for order in ([0, 1, 2, 3, 4], [1, 0, 3, 2, 4], [4, 3, 2, 1, 0]):
        df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, width=3, percent=85).collect())
        assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (7, 2, False), (9, 9, True)]


def test_large_buckets_in_small_blocks(spark, monkeypatch):
    """Groups of several parts, more classes than a block holds: whole intersections tell."""
    from docweave.llm import minhash

    monkeypatch.setattr(minhash, "_SMALL", 2)
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"new{k}x{j}y{i}" for i in range(n)] + base[k + n :]) for k in range(0, 90, 9) for j in range(3) for n in (1, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width=3, percent=92).collect()}
    assert got == brute.near_components(list(enumerate(texts)), 3, 92)


def test_drop_near_duplicates_keeps_columns(odd):
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    want = brute.near_components(pairs_of(odd), 5, 80)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_remove_repeats(request, name):
    df = request.getfixturevalue(name).where("length(text) < 200000 or text is null")
    done = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in done.collect()} == brute.remove_repeats(pairs_of(df), 400)


def test_remove_repeats_with_hot_anchors(spark):
    """A passage in very many differing surroundings goes the way by cells."""
    passage = " ".join(f"shared{i}" for i in range(70))
    texts = [f"begin {i * 7919} {'a' * (i % 13)} " + passage[i % 40 :] + f" {i * 104729} end" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = remove_repeats(df, hot_kinds=4, block_bytes=4096).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in done.collect()} == brute.remove_repeats(list(enumerate(texts)), 400)


def test_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(None, text, "en", "a"), (None, text, "en", "a"), (1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert count_tokens(df, BYTE_BPE).count() == 5
    assert quality_rules(df).where("kept").count() == 4
    assert dedup_lines(df).where("n_dropped > 0").count() == 0
    near = near_duplicates(df).collect()
    assert len(near) == 5 and all(r["component_id"] is None and r["kept"] for r in near if r["doc_id"] is None)
    assert remove_repeats(df).where("n_removed > 0").count() == 4


def test_empty_tables(none):
    assert count_tokens(none, BYTE_BPE).count() == 0
    assert quality_rules(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert remove_repeats(none).count() == 0
