"""The best labels of sparse vectors against a plain version, with terms that all rows hold."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.operators import sparse, taxonomy, training

WORDS = "id long, words array<string>"
EXAMPLES = "eid long, words array<string>"


def plain_overlap(docs, examples, k):
    out = {}
    for i, words in docs:
        shared = [(-len(set(words or []) & set(w or []) - {None}), e) for e, w in examples]
        for place, (n, e) in enumerate(sorted(x for x in shared if x[0])[:k], 1):
            out[i, place] = (e, -n)
    return out


def found_overlap(spark, docs, examples, k, frequent):
    got = taxonomy.similar_examples(spark.createDataFrame(docs, WORDS), spark.createDataFrame(examples, EXAMPLES), k=k, frequent=frequent)
    rows = got.collect()
    out = {(r["id"], r["place"]): (r["eid"], r["n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def texts(seed, n, start):
    """Texts of common, middling and rare words, with copies, none at all and nulls."""
    r = random.Random(seed)
    out = [(start, None), (start + 1, []), (start + 2, [None, "c0"])]
    for i in range(3, n):
        words = [f"c{w}" for w in range(6) if r.random() < 0.8] + [f"m{r.randrange(12)}" for _ in range(3)] + [f"r{r.randrange(60)}" for _ in range(r.randrange(3))]
        out.append((start + i, out[-1][1] if i % 5 == 0 else words))
    return out


@pytest.mark.parametrize("frequent", [0, 2, 8, 1000])
def test_overlap_is_exact_for_any_limit(spark, frequent):
    docs, examples = texts(1, 60, 0), texts(2, 45, 500)
    assert found_overlap(spark, docs, examples, 3, frequent) == plain_overlap(docs, examples, 3)


def test_overlap_of_empty_tables(spark):
    docs = texts(1, 8, 0)
    assert found_overlap(spark, docs, [], 3, 2) == {} and found_overlap(spark, [], docs, 3, 2) == {}


def test_blocks_of_any_size(spark):
    docs, examples = texts(3, 40, 0), texts(4, 40, 0)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, words array<string>").select(key, F.explode(F.array_distinct("words")).alias("term"), F.lit(1.0).alias("weight"))
    asked, held = frame(docs, "id"), frame(examples, "row")
    names = spark.createDataFrame([(e, e) for e, _ in examples], "row long, label long")
    got = sparse.best_labels(asked, held, names, k=4, frequent=0, block=7).collect()
    assert {(r["id"], r["place"]): (r["label"], int(r["score"])) for r in got} == plain_overlap(docs, examples, 4)


def test_met_pairs_grow_with_the_table(spark):
    """Each text holds 50 words that all hold; four texts share each of their other words."""

    def met(n):
        rows = spark.range(n).select(F.col("id"), F.concat(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda w: F.concat(F.lit("all"), w)), F.array(F.concat(F.lit("some"), (F.col("id") / 4).cast("long")))).alias("words"))
        exploded = rows.select("id", F.explode("words").alias("term"), F.lit(1.0).alias("weight"))
        one, two = sparse.split_terms(exploded, exploded.withColumnRenamed("id", "row"), 16)
        best = taxonomy.similar_examples(rows, rows.withColumnRenamed("id", "eid"), frequent=16)
        assert best.where("n = 51 and floor(eid / 4) = floor(id / 4)").count() == 3 * n
        return sparse.met_pairs(one, two).count()

    assert (met(100), met(400)) == (400, 1600)


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_router_is_exact_for_any_limit(spark, frequent):
    made = [(i, " ".join(w for w in words or [] if w)) for i, words in texts(5, 40, 0)]
    docs = spark.createDataFrame(made, "id long, content_text string")
    weights, idf = training.fit_tfidf(docs, max_features=None)
    names = docs.select("id", F.when(F.col("id") != 7, F.concat(F.lit("l"), F.col("id") % 6)).alias("label"))
    vectors = defaultdict(dict)
    for r in weights.collect():
        vectors[r["id"]][r["term"]] = r["weight"]
    want = {}
    for i, v in vectors.items():
        best = defaultdict(float)
        for row, held in vectors.items():
            if row != 7:
                best[f"l{row % 6}"] = max(best[f"l{row % 6}"], sum(w * held.get(t, 0.0) for t, w in v.items()))
        for place, (s, name) in enumerate(sorted((-round(s, 9), name) for name, s in best.items() if round(s, 9) > 0)[:3], 1):
            want[i, place] = (name, -s)
    got = {(r["id"], r["place"]): (r["label"], r["score"]) for r in training.route(docs, idf, weights, names, k=3, frequent=frequent).collect()}
    assert got.keys() == want.keys()
    for at, (name, score) in want.items():
        assert got[at][1] == pytest.approx(score, abs=2e-9)
        assert got[at][0] == name or abs(got[at][1] - score) <= 2e-9


@pytest.mark.parametrize("few", [-1, 1 << 18])
@pytest.mark.parametrize("frequent", [0, 8, 1000])
def test_overlap_is_the_same_by_broadcast_and_by_shuffles(spark, monkeypatch, few, frequent):
    monkeypatch.setattr(sparse, "_FEW", few)
    monkeypatch.setattr(sparse, "_AT_ONCE", 500)
    docs, examples = texts(5, 60, 0), texts(6, 45, 500)
    assert found_overlap(spark, docs, examples, 3, frequent) == plain_overlap(docs, examples, 3)


def test_few_examples_shuffle_no_words(spark):
    docs, examples = spark.createDataFrame(texts(7, 30, 0), WORDS), spark.createDataFrame(texts(8, 20, 500), EXAMPLES)
    plan = taxonomy.similar_examples(docs, examples)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
