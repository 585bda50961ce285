"""Landed messages: restarts lose nothing and repeat nothing."""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from docweave.sources.landed import messages_since
from docweave.streaming import jobs

SCHEMA = "id string, internal_date_ms long, body string"


def land(folder, name, rows, **how):
    os.makedirs(folder, exist_ok=True)
    ids, dates = zip(*rows, strict=True) if rows else ((), ())
    columns = {"extra": pa.array([0] * len(ids)), "internal_date_ms": pa.array(dates, pa.int64()), "body": pa.array([f"text {i}" for i in ids], pa.string()), "id": pa.array(ids, pa.string())}
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet", **how)


def drain(spark, base, seen):
    """A new query on the same checkpoint, as after a restart."""
    stream = messages_since(spark, f"file://{base}/in", SCHEMA)
    query = jobs.run_available(stream, f"file://{base}/state", lambda batch, _: seen.extend(map(tuple, batch.select("id", "internal_date_ms", "body").collect())))
    query.awaitTermination()


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    seen = []
    land(tmp_path / "in", "a", [("m1", 1_000), ("m2", 60_000), ("m3", 60_500), ("none", None)])
    land(tmp_path / "in", "b", [("m2", 60_000), ("m4", 30_000)], row_group_size=1)
    land(tmp_path / "in", "empty", [])
    drain(spark, tmp_path, seen)
    assert sorted(seen) == [("m1", 1_000, "text m1"), ("m2", 60_000, "text m2"), ("m3", 60_500, "text m3"), ("m4", 30_000, "text m4")]
    drain(spark, tmp_path, seen)  # nothing new
    assert len(seen) == 4
    land(tmp_path / "in" / "later", "c", [("m3", 60_500), ("m5", 59_800), ("m6", 70_000), ("old", 20_000), ("m6", 70_000)], write_statistics=False)
    drain(spark, tmp_path, seen)
    assert sorted(r[0] for r in seen[4:]) == ["m5", "m6"]  # m5 landed late but within the overlap
    land(tmp_path / "in", "d", [("m7", 70_000), ("m8", 3_600_000), ("m6", 70_000)])
    drain(spark, tmp_path, seen)
    drain(spark, tmp_path, seen)
    assert Counter(r[0] for r in seen) == Counter(["m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8"])


def test_an_empty_folder_waits(spark, tmp_path):
    seen = []
    drain(spark, tmp_path, seen)
    assert seen == []
    land(tmp_path / "in", "a", [("m1", 5)])
    drain(spark, tmp_path, seen)
    assert [r[0] for r in seen] == ["m1"]
