"""Streaming jobs: resumable ingestion, change detection, idempotent events and leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files_stream(spark: SparkSession, path: str, schema: str, *, per_trigger: int = 100, form: str = "parquet") -> DataFrame:
    """A stream of new files of a folder, at most ``per_trigger`` a batch."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def run_every(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], *, seconds: int = 1800) -> StreamingQuery:
    """Work off what is new every ``seconds``, until it is stopped; a rerun goes on where the checkpoint ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def pause_all(spark: SparkSession, name: str | None = None) -> list[str]:
    """Stops running queries, all or those of a name; started again with their checkpoints they resume. Returns their ids."""
    stopped = []
    for query in spark.streams.active:
        if name is None or query.name == name:
            query.stop()
            stopped.append(query.id)
    return stopped


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is there in batches, then stop; a rerun goes on where the checkpoint ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def new_events(stream: DataFrame, key: list[str], when: str, delay: str) -> DataFrame:
    """Each event once: repeats within the watermark's delay are dropped."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark(key)


def event_id(*parts: str) -> Any:
    """The content hash that names an event."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (last,) = state.get if state.exists else (None,)
    for pdf in batches:
        pdf = pdf.sort_values("seq", kind="stable")
        before = pdf["fingerprint"].shift()
        before.iloc[0] = last
        hit = (before.isna() | (before != pdf["fingerprint"])).to_numpy()
        last = pdf["fingerprint"].iloc[-1]
        change = before.isna().map({True: "new", False: "changed"})
        yield pd.DataFrame({"key": key[0], "seq": pdf["seq"][hit], "fingerprint": pdf["fingerprint"][hit], "change": change[hit]})
    if last is not None:
        state.update((last,))


def changes(stream: DataFrame) -> DataFrame:
    """(key, seq, fingerprint, change) where a key's fingerprint differs from the last one kept in state."""
    return stream.groupBy("key").applyInPandasWithState(_changes, "key string, seq long, fingerprint string, change string", "fingerprint string", "append", GroupStateTimeout.NoTimeout)


def _leases(seconds: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended = None
        if state.hasTimedOut:
            (ended,) = state.get
            state.remove()
        else:
            last = max([*(int(pdf["ms"].max()) for pdf in batches), *([state.get[0]] if state.exists else [])])
            if last + 1000 * seconds <= state.getCurrentWatermarkMs():
                ended = last
                if state.exists:
                    state.remove()
            else:
                state.update((last,))
                state.setTimeoutTimestamp(last + 1000 * seconds)
        if ended is not None:
            yield pd.DataFrame({"job": [key[0]], "last_beat_ms": [ended]})

    return run


def lease_expiry(stream: DataFrame, when: str, seconds: int) -> DataFrame:
    """(job, last_beat_ms) of each lease that ends: event time has gone ``seconds`` past a job's last heartbeat. A later beat opens
    a new lease."""
    beats = stream.withWatermark(when, "0 seconds").select("job", F.unix_millis(when).alias("ms"), when)
    return beats.groupBy("job").applyInPandasWithState(_leases(seconds), "job string, last_beat_ms long", "ms long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, when: str, key: str, *, size: str, delay: str) -> DataFrame:
    return stream.withWatermark(when, delay).groupBy(F.window(when, size), key).agg(F.count(F.lit(1)).alias("n"))


def since(rows: DataFrame, when: str, watermark_ms: int, overlap_ms: int = 1000) -> DataFrame:
    """Rows from the watermark on, with an overlap that later de-duplication takes out."""
    return rows.where(F.unix_millis(when) >= watermark_ms - overlap_ms)
