"""Bounded drains with failing jobs, and the parts of messages."""

from __future__ import annotations

import base64
import json

import pytest

from docweave.sources.messages import message_parts, message_text
from docweave.streaming import jobs
from docweave.streaming.drain import Drain

SCHEMA = "id long, payload string"


def label(number, payload, attempt):
    if payload == "broken":
        raise ValueError("no text")
    if payload == "slow" and attempt < 2:
        raise TimeoutError(payload)
    return f"{payload}!"


def test_failing_jobs_are_tried_and_hold_nobody_up(spark, tmp_path):
    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return jobs.files_stream(spark, f"{tmp_path}/in", SCHEMA, per_trigger=1)

    drain = Drain(spark, f"file://{tmp_path}/q", label, most=3)
    assert drain.results().collect() == [] and drain.dead().collect() == []
    land([(1, "a"), (2, "broken")])
    drain.run(land([(3, "slow"), (4, "b"), (5, None)]))
    done = sorted(map(tuple, drain.results().collect()))
    assert done == [(1, "a!"), (3, "slow!"), (4, "b!"), (5, "None!")]
    assert [tuple(r) for r in drain.dead().collect()] == [(2, "broken", 3, "ValueError: no text")]
    steps = {(r["id"], r["attempt"]): r["step"] for r in drain.outcomes().collect()}
    assert steps[2, 1] == 0 and steps[2, 2] == steps[3, 1] == 1000 and steps[2, 3] == steps[3, 2] == 1001
    before = drain.outcomes().count()
    drain.run(land([(6, "c")]))
    assert sorted(r["id"] for r in drain.results().collect()) == [1, 3, 4, 5, 6] and drain.outcomes().count() == before + 1


def test_a_step_that_broke_off_is_done_again(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "broken")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.files_stream(spark, f"{tmp_path}/in", SCHEMA)
    drain = Drain(spark, f"file://{tmp_path}/q", label, most=1)
    write = Drain._step
    Drain._step = lambda self, step, rows: (write(self, step, rows), 1 / 0)  # dies after writing, before the batch is noted
    try:
        with pytest.raises(Exception, match="division by zero"):
            drain.run(stream)
    finally:
        Drain._step = write
    drain.run(stream)
    assert [tuple(r) for r in drain.results().collect()] == [(1, "a!")] and drain.dead().count() == 1


def data(text):
    return {"data": base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")}


def test_message_parts(spark):
    inner = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "Text/Plain ", "body": data("in ß>>>???")}, {"mimeType": "text/html", "body": data("<b>")}, "no part"]}
    root = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": data("first")}, inner, {"mimeType": "text/plain", "body": {}}]}
    rows = [(1, json.dumps(root)), (2, json.dumps({"mimeType": "text/plain", "body": data("alone"), "parts": []})), (3, None), (4, "[]"), (5, "{broken")]
    parts = message_parts(spark.createDataFrame(rows, "id long, payload string"))
    got = sorted((r["id"], r["path"], r["depth"], r["mime_type"], r["data"]) for r in parts.collect())
    assert got == [
        (1, "0", 0, "multipart/mixed", None), (1, "0.0", 1, "text/plain", "first"), (1, "0.1", 1, "multipart/alternative", None),
        (1, "0.1.0", 2, "text/plain", "in ß>>>???"), (1, "0.1.1", 2, "text/html", "<b>"), (1, "0.2", 1, "text/plain", None), (2, "0", 0, "text/plain", "alone"),
    ]
    assert {r["id"]: r["text"] for r in message_text(parts).collect()} == {1: "in ß>>>???", 2: "alone"}
