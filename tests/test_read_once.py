"""What jobs read and keep: a log made once, and only fingerprints that may make groups."""

from __future__ import annotations

import datetime

from docweave.operators import changesets
from docweave.streaming.dedupe_job import DedupeJob


def test_a_log_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    schema = "id long, change_set string, op string, path string, target string"
    rows = [(1, "a", "move", "/x", "/y"), (2, "b", "delete", "/y", "/b/2"), (3, "b", "create", None, "/x")]
    log = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    files = spark.createDataFrame([(7, "/x")], "file long, path string")
    found = changesets.restored_tree(files, log, spark.createDataFrame([("b",)], "change_set string")).collect()
    assert {(r["file"], r["born"], r["path"], r["state"]) for r in found} == {(7, None, "/y", "restored"), (None, 3, "/x", "live")}
    assert made.value == 3


def test_only_shared_fingerprints_are_landed(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    files = spark.createDataFrame([(i, f"/a/f{i}.txt", f"f{i}.txt", 10, at, False) for i in range(8)], "id long, path string, name string, size_bytes long, modified_at timestamp, is_deleted boolean")
    contents = spark.createDataFrame([(i, "same" if i in (2, 6) else f"h{i}") for i in range(8)], "file_id long, content_hash string")
    job = DedupeJob.create(files, contents, f"{tmp_path}/job", strategies=["content_hash", "normalized_name_size"], chunk_size=5, max_groups=None)
    status = job.advance(chunks=3)
    landed = spark.read.parquet(f"{tmp_path}/job/landed/*").collect()
    assert sorted(r["id"] for r in landed) == [2, 6]
    assert (status["status"], status["processed_count"], status["groups_found"]) == ("complete", 8, 1)
    assert [r["duplicate_count"] for r in job.found().collect()] == [1]
