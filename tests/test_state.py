"""Keyed state with timers: leases, fingerprints that are forgotten, and duplicate search in chunks."""

from __future__ import annotations

import time

import pytest

from docweave.operators import dedupe
from docweave.streaming import jobs, state
from docweave.streaming.dedupe_job import DedupeJob


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def rows_of(spark, path, *columns):
    try:
        return sorted(tuple(r) for r in spark.read.parquet(path).select(*columns).collect())
    except Exception:  # nothing is written yet
        return []


def wait_for(wanted, seconds=60):
    until = time.time() + seconds
    while time.time() < until:
        if wanted():
            return True
        time.sleep(0.5)
    return False


def test_leases_end_without_another_event(spark, tmp_path):
    schema = "job string, worker string, beat_ms long"
    land(spark, tmp_path, [("a", "w1", 5), ("a", "w2", 9), ("b", "w1", 7)], schema)
    ended = state.ended_leases(jobs.files_stream(spark, f"{tmp_path}/in", schema), 3)
    query = jobs.run_every(ended, f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out"), seconds=1)
    try:
        assert wait_for(lambda: len(rows_of(spark, f"{tmp_path}/out", "job")) == 2)
        assert rows_of(spark, f"{tmp_path}/out", "job", "worker", "last_beat_ms") == [("a", "w2", 9), ("b", "w1", 7)]
        land(spark, tmp_path, [("a", "w3", 20)], schema)  # a new lease
        assert wait_for(lambda: ("a", "w3", 20) in rows_of(spark, f"{tmp_path}/out", "job", "worker", "last_beat_ms"))
    finally:
        query.stop()


def test_fingerprints_are_forgotten_after_their_time(spark, tmp_path):
    schema = "key string, seq long, fingerprint string"
    land(spark, tmp_path, [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], schema)
    stream = jobs.files_stream(spark, f"{tmp_path}/in", schema)

    query = jobs.run_every(state.fingerprint_changes(stream, keep_seconds=15), f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out"), seconds=1)
    seen = lambda: rows_of(spark, f"{tmp_path}/out", "seq", "change")
    try:
        assert wait_for(lambda: seen() == [(1, "new"), (3, "changed")])
        land(spark, tmp_path, [("a", 4, "y"), ("b", 4, "z")], schema)  # a is known still
        assert wait_for(lambda: (4, "new") in seen())
        assert seen() == [(1, "new"), (3, "changed"), (4, "new")]
        time.sleep(17)
        land(spark, tmp_path, [("a", 5, "y")], schema)
        assert wait_for(lambda: (5, "new") in seen())
    finally:
        query.stop()


def test_fingerprints_kept_for_good(spark, tmp_path):
    schema = "key string, seq long, fingerprint string"
    for rows in [[("a", 1, "x"), ("a", 2, "y")], [("a", 3, "y"), ("a", 4, "x")]]:
        land(spark, tmp_path, rows, schema)
        stream = jobs.files_stream(spark, f"{tmp_path}/in", schema)
        assert jobs.run_available(state.fingerprint_changes(stream), f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out")).awaitTermination(60)
    assert rows_of(spark, f"{tmp_path}/out", "seq", "change") == [(1, "new"), (2, "changed"), (4, "changed")]


FILES = "id long, name string, path string, size_bytes long, is_deleted boolean, modified_at timestamp"


@pytest.fixture(scope="module")
def tables(spark):
    hashes = ["h1", "h2", "h1", "h3", "h3", "h2", "h1", "h4", "h5", "h5", "h9", "h4"]
    files = [(10 * i, f"n{i}.txt", f"/src/{'_in/' if i == 4 else ''}n{i}.txt", 5, i == 8, None) for i in range(12)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame([(10 * i, h) for i, h in enumerate(hashes)], "file_id long, content_hash string")


@pytest.mark.parametrize(("chunk", "most"), [(3, 2), (5, None)])
def test_chunked_job_gives_what_a_whole_run_gives(spark, tmp_path, tables, chunk, most):
    files, contents = tables
    folder = f"file://{tmp_path}/job"
    job = DedupeJob.create(files, contents, folder, strategies=["content_hash"], chunk_size=chunk, max_groups=most)
    assert job.status() == {"status": "queued", "cursor": None, "processed_count": 0, "remaining_count": 11, "groups_found": 0}
    first = job.advance()
    assert first["status"] == "running" and first["processed_count"] == chunk
    job._land()  # a driver that dies after landing a chunk
    job = DedupeJob(spark, folder, chunk, most)
    steps = 0
    while job.advance()["status"] != "complete":
        steps += 1
        assert steps < 10
    wanted = dedupe.run(files, contents, strategies=["content_hash"], max_groups=most or 200)
    assert sorted(map(str, job.found().collect())) == sorted(map(str, wanted.collect()))
    end = job.status()
    assert (end["groups_found"], end["processed_count"], end["remaining_count"]) == ((2, 6, 5) if most else (3, 11, 0))
    assert job.advance() == end  # a complete job stays


def test_job_without_candidates(spark, tmp_path, tables):
    files, contents = tables
    job = DedupeJob.create(files.limit(0), contents, f"file://{tmp_path}/none", strategies=["content_hash"])
    assert job.advance()["status"] == "complete" and job.found().collect() == []
