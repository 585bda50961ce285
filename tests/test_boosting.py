"""Boosted trees against a plain booster, their heads and their constant models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators.boosting import UNIT, fit_boosted, fit_words, gradients, predict_heads, softmax, train_heads
from docweave.operators.training import count_terms, fit_tfidf, weigh

WORDS = ["tax", "form", "poem", "sea", "bank", "letter", "claim", "of", "and"]


def texts(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = ["bank", "poem", "tax"][int(rng.integers(0, 3))]
        words = rng.choice(WORDS, int(rng.integers(0, 12))).tolist() + ([label] if rng.random() < 0.8 else [])
        rows.append((i, " ".join(words) or None, None if i % 13 == 0 else label, bool(rng.random() < 0.4), False))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(texts(4, 160), "id long, content_text string, label string, used_inline_llm boolean, disagreement boolean").repartition(4)


def plain_trees(codes, target, n_classes, size, bins, rounds, depth, leaves, rate):
    """Level by level, over a dense matrix of bins, in whole numbers."""
    held = np.full((len(codes), size), -1)
    for i, own in enumerate(codes):
        for c in own:
            held[i, c // bins] = c % bins
    share = np.bincount(target, minlength=n_classes) / len(target)
    scores = np.tile(np.log(share), (len(codes), 1))
    least = int(1e-3 * UNIT)
    for _ in range(rounds):
        g, h = gradients(scores, target)
        for k in range(n_classes):
            groups, n_leaves = [np.ones(len(codes), bool)], 1
            final = []
            for level in range(depth + 1):
                options = []
                for own in groups:
                    total_g, total_h = int(g[own, k].sum()), int(h[own, k].sum())
                    best = None
                    for f in range(size if level < depth else 0):
                        for v in sorted(set(held[own, f].tolist()) - {-1}):
                            right = own & (held[:, f] >= v)
                            gr, hr = int(g[right, k].sum()), int(h[right, k].sum())
                            gl, hl = total_g - gr, total_h - hr
                            if right.sum() and (own & ~right).sum() and hr >= least and hl >= least:
                                gain = float(gr) * gr / hr + float(gl) * gl / hl - float(total_g) * total_g / total_h
                                if gain > 0 and (best is None or (gain, -(f * bins + v)) > best[:2]):
                                    best = (gain, -(f * bins + v), right)
                    options.append((own, best, -rate * total_g / max(total_h, 1)))
                groups = []
                for own, best, value in sorted(options, key=lambda o: -(o[1][0] if o[1] else 0.0)):
                    if best is None or n_leaves == leaves:
                        final.append((own, value))
                    else:
                        n_leaves += 1
                        groups += [own & ~best[2], best[2]]
            for own, value in final:
                scores[own, k] += value
    return softmax(scores)


@pytest.mark.parametrize(("rewrite", "leaves"), [(2, 15), (8, 3)])
def test_trees_equal_a_plain_booster(spark, rows, rewrite, leaves):
    rows = rows.repartition(rewrite)  # sums are exact, so neither this nor when scores are written back matters
    labelled = rows.where("label is not null")
    words = fit_words(labelled, most=12, bins=4)
    model = fit_boosted(rows, words, "label", rounds=3, depth=3, leaves=leaves, rewrite=rewrite)
    assert model.classes == ["bank", "poem", "tax"] and len(model.rounds) == 3
    coded = words.codes(labelled).join(labelled.select("id", "label"), "id")
    known = {r["id"]: (r["codes"], model.classes.index(r["label"])) for r in coded.collect()}
    ids = sorted(known)
    wanted = plain_trees([known[i][0] for i in ids], np.array([known[i][1] for i in ids]), 3, words.size, 4, 3, 3, leaves, 0.1)
    got = {r["id"]: r["p"] for r in model.probabilities(words.codes(labelled), "p").collect()}
    assert np.abs(np.array([got[i] for i in ids]) - wanted).max() < 1e-12
    assert np.mean(wanted.argmax(1) == [known[i][1] for i in ids]) > 0.6


def test_heads(spark, rows):
    heads = train_heads(rows, most=20, rounds=3, depth=2)
    assert heads.disagreement.classes == [False] and heads.disagreement.rounds == []
    out = predict_heads(rows, heads, most=2, listed=3).collect()
    assert len(out) == 160
    for r in out:
        assert len(r["top_labels"]) == 2 and r["top_labels"][0] == r["top_label"]
        assert sum(r["label_probabilities"].values()) == pytest.approx(1.0) and r["label_probabilities"][r["top_label"]] == r["top_probability"]
        assert 0.0 < r["needs_llm_probability"] < 1.0 and r["disagreement_risk"] == 0.0


def test_one_class_and_no_rows(spark, rows):
    one = rows.withColumn("label", F.lit("tax"))
    words = fit_words(one, most=5)
    model = fit_boosted(one, words, "label")
    assert model.rounds == [] and {tuple(r["p"]) for r in model.probabilities(words.codes(rows), "p").collect()} == {(1.0,)}
    with pytest.raises(ValueError):
        fit_boosted(rows.where("false"), words, "label")


def test_rows_without_words(spark, rows):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "unknown words only")], "id long, content_text string")
    words = fit_words(rows.where("label is not null"), most=12)
    assert [r["codes"] for r in words.codes(empty).collect()] == [[], [], []]
    model = fit_boosted(rows, words, "label", rounds=1, depth=2)
    assert len({tuple(r["p"]) for r in model.probabilities(words.codes(empty), "p").collect()}) == 1


def test_words_are_coded_without_a_shuffle(spark):
    """Codes equal those by exploded terms, and rows stay where they lie."""
    texts = [(1, "the sea the sea of_tax Été été x"), (2, None), (3, ""), (4, "sea"), (5, "a b c"), (6, "tax form, tax form and the sea " * 30), (7, "été the the the")]
    rows = spark.createDataFrame(texts, "id long, content_text string").repartition(3)
    words = fit_words(rows, most=12, bins=16)
    _, idf = fit_tfidf(rows, max_features=12)
    assert {r["term"]: round(r["idf"], 12) for r in words.terms.collect()} == {r["term"]: round(r["idf"], 12) for r in idf.collect()}
    coded = words.codes(rows)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    level = F.least(F.floor(F.sqrt("weight") * 16), F.lit(15)).cast("int")
    plain = weigh(count_terms(rows), idf).join(words.terms.drop("idf"), "term").select("id", (F.col("feature") * 16 + level).cast("int").alias("code"))
    expected = {i: [] for i, _ in texts}
    for r in plain.collect():
        expected[r["id"]].append(r["code"])
    assert {r["id"]: r["codes"] for r in coded.collect()} == {i: sorted(c) for i, c in expected.items()}
