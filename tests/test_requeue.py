"""Both feeds of the queue, and label cleaners, on odd values."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import queueing


def test_both_feeds_in_order(spark):
    day = lambda n: f"2024-01-{n:02d}"
    files = spark.createDataFrame([(i, "/a/SMS/x" if i != 6 else "/a/b", "txt" if i != 5 else "zip", i == 7) for i in range(1, 11)] + [(11, None, None, None)], "id long, path string, extension string, is_deleted boolean")
    feedback = spark.createDataFrame([(1, 1, "tax", day(5)), (2, 1, "bank", day(1)), (3, 2, "tax", day(5)), (4, 3, "tax", day(1)), (5, 9, "tax", day(5)), (6, 99, "tax", day(5)), (7, 10, " ", day(9))], "id long, file_id long, label string, recorded_at string").withColumn("recorded_at", F.to_timestamp("recorded_at"))
    states = spark.createDataFrame(
        [(1, "bank", day(2), "completed", None), (2, "tax", None, "completed", None), (3, "bank", day(2), "completed", None), (4, None, None, "completed", None), (5, "", None, "completed", None), (6, "", None, "completed", None), (7, "", None, "completed", None), (8, "tax", None, "completed", "/vault/02 Needs Review/n.md"), (10, "", None, "failed", None)],
        "file_id long, primary_label string, completed_at string, submission_status string, classifier_note_path string",
    ).withColumn("completed_at", F.to_timestamp("completed_at"))
    none = spark.createDataFrame([], "file_id long, status string")
    busy = spark.createDataFrame([(8, "running"), (9, "completed")], "file_id long, status string")
    rows = lambda jobs, n: [tuple(r) for r in queueing.requeue_all(feedback, files, states, jobs, n).collect()]
    assert rows(none, 9) == [(1, 0), (9, 0), (4, 1), (8, 1)]
    assert rows(busy, 9) == [(1, 0), (9, 0), (4, 1)] and rows(none, 1) == [(1, 0)] and rows(none, 0) == []


def test_label_cleaners(spark):
    raws = ["  Tax & Law # comment", "A/b_c.d-e", "#", None, "--x  y--", "é&"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [tuple(r) for r in df.orderBy("i").select(*(f(F.col("raw")) for f in (text.category_label, text.route_label, text.alias_label))).collect()]
    assert got == [("tax-and-law", "tax-law-comment", "tax-and-law-comment"), ("a/b_c.d-e", "a/b_c.d-e", "a-b-c-d-e"), ("", "", ""), ("", "", ""), ("x-y", "x-y", "x-y"), ("and", "", "and")]
