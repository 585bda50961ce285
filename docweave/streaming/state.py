"""Operators with keyed state and timers: leases, changes of fingerprints and chunked duplicate search.

They run on ``transformWithStateInPandas``, which keeps its state in RocksDB (``with_state_store``). State is partitioned by key, so
it grows with the keys and not in one task, and is restored from the checkpoint when executors are lost.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# processors are also opened in a process of the driver that doesn't know this package, so they travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Have the streams of a session keep state in RocksDB, as these operators ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def _frame(**columns: list) -> pd.DataFrame:
    """Columns of Python objects: strings of pandas' own kind come in chunks, which the state's serializer doesn't take."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})


class Leases(StatefulProcessor):
    """A job's last heartbeat, and a timer for when its lease ends. Beats move the timer; when it fires, the lease is reported
    and forgotten. Times of beats are those of the machine (processing time), so a lease ends without another event."""

    def __init__(self, seconds: float) -> None:
        self.ms = int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "beat_ms long, worker string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        latest = pd.concat(list(rows)).sort_values("beat_ms", kind="stable").iloc[-1]
        beat, worker = int(latest["beat_ms"]), latest["worker"]
        if self.last.exists():
            old_beat, old_worker = self.last.get()
            if old_beat > beat:
                beat, worker = old_beat, old_worker
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.last.update((beat, worker))
        self.handle.registerTimer(now + self.ms)
        yield _frame(job=[], worker=[], last_beat_ms=[])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        beat, worker = self.last.get()
        self.last.clear()
        yield _frame(job=[key[0]], worker=[worker], last_beat_ms=[beat])

    def close(self) -> None:
        pass


def ended_leases(beats: DataFrame, seconds: float) -> DataFrame:
    """(job, worker, last_beat_ms) of each lease that ends: no beat (job, worker, beat_ms) has come for ``seconds`` by the clock
    of the executors, also if nothing comes on the stream any more. A later beat opens a new lease."""
    with_state_store(beats.sparkSession)
    return beats.groupBy("job").transformWithStateInPandas(Leases(seconds), "job string, worker string, last_beat_ms long", "append", "ProcessingTime")


class Fingerprints(StatefulProcessor):
    """A key's last fingerprint, kept for a time to live."""

    def __init__(self, keep_seconds: float | None) -> None:
        self.ttl = None if keep_seconds is None else int(1000 * keep_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("fingerprint", "fingerprint string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        seen = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = seen["fingerprint"].shift()
        before.iloc[0] = known
        hit = (before.isna() | (before != seen["fingerprint"])).to_numpy()
        self.last.update((seen["fingerprint"].iloc[-1],))  # also renews the time to live
        change = before.isna().map({True: "new", False: "changed"})
        yield _frame(key=[key[0]] * int(hit.sum()), seq=seen["seq"][hit], fingerprint=seen["fingerprint"][hit], change=change[hit])

    def close(self) -> None:
        pass


def fingerprint_changes(stream: DataFrame, *, keep_seconds: float | None = None) -> DataFrame:
    """(key, seq, fingerprint, change) where a key's fingerprint differs from the last one kept in state. A key that has not been
    seen for ``keep_seconds`` is forgotten, and new when it comes again; such a stream has a batch at every trigger, so it is run
    at intervals (``run_every``), not until nothing is left."""
    with_state_store(stream.sparkSession)
    mode = "None" if keep_seconds is None else "ProcessingTime"
    return stream.groupBy("key").transformWithStateInPandas(Fingerprints(keep_seconds), "key string, seq long, fingerprint string, change string", "append", mode)


class SecondMembers(StatefulProcessor):
    """Of each group (strategy, fingerprint): its two smallest ids so far. Reports the second one when it is found or becomes
    smaller, so what is kept and reported of a group is bounded however many members it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.two = handle.getValueState("two", "first long, second long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = [i for i in (self.two.get() if self.two.exists() else ()) if i is not None]
        ids = set(known)
        for part in rows:
            ids |= set(part["id"].nsmallest(2).tolist())
            ids = set(sorted(ids)[:2])
        found = sorted(ids)
        self.two.update((found[0], found[1] if len(found) > 1 else None))
        new = found[1:] != known[1:]
        yield _frame(strategy=[key[0]][:new], fingerprint=[key[1]][:new], second=found[1:][:new])

    def close(self) -> None:
        pass


def second_members(fingerprinted: DataFrame) -> DataFrame:
    """(strategy, fingerprint, second): the id by which a group becomes one of two. Ids are unique, chunks may come in any order."""
    with_state_store(fingerprinted.sparkSession)
    return fingerprinted.groupBy("strategy", "fingerprint").transformWithStateInPandas(SecondMembers(), "strategy string, fingerprint string, second long", "append", "None")
