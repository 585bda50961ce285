"""Texts are searched once for each pattern, and put in lower case once for all words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import dataset, labels, retrieval


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_retrieval_metadata_searches_each_pattern_once(spark):
    docs = spark.createDataFrame([(1, "/a/b.txt", "Patient: Ann\nclaim # AB-12, 2024-01-01", ["legal"])], "id long, path string, content_text string, labels array<string>")
    found = retrieval.retrieval_metadata(docs)
    plan = optimized(found)
    assert plan.count("regexp_extract_all(") == 6  # five patterns of entities, and tokens
    assert found.first()["entity_summary"] == "people: Ann; identifiers: claim #: AB-12; dates: 2024-01-01"


def test_matches_alone_have_the_parts_they_have_in_the_text(spark):
    body = "patient name : Ann  Lee, \nclaim id: X1/2 provider - " + "y" * 150 + "\nbank/issuer name# Z | Policy AB12 account number 12345 doctor:ab"
    rows = spark.createDataFrame([(body,)], "t string")
    for pattern in (retrieval.LABELED, retrieval.IDENTIFIER):
        for group in (1, 2):
            whole = F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
            alone = F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), lambda m: F.regexp_extract(m, pattern, group))
            one, two = rows.select(whole, alone).first()
            assert one == two and one


def test_labels_and_topics_take_a_text_in_lower_case_once(spark):
    rules = {f"label{i}": [f"word{i}", f"other{i}"] for i in range(8)}
    rows = spark.createDataFrame([("A word3 and OTHER3", "txt", "text/plain")], "t string, e string, m string")
    found = rows.select(labels.ranked_labels(F.col("t"), F.col("e"), F.col("m"), rules).alias("r"))
    assert optimized(found).count("lower(t") == 1
    assert [(r["score"], r["n_evidence"], r["label"], r["evidence"]) for r in found.first()["r"][:2]] == [(4, 2, "label3", ["word3", "other3"]), (0, 0, "label7", [])]
    topics = rows.select(retrieval.topics(F.lower("t"), F.array().cast("array<string>")).alias("x"))
    assert optimized(topics).count("lower(t") == 1


def test_words_of_topics_are_no_patterns():
    assert all(w.replace("-", "").replace(" ", "").isalnum() for words in dataset.SENSITIVE.values() for w in words)
