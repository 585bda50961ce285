"""A queue of jobs worked off in bounded batches, with failures tried again and kept apart in the end.

All that happens is one table, ``outcomes``, by step: what each job gave or why it failed, and at which attempt. A step is a batch
of the stream or a round of retries after it; run again, it replaces itself. The jobs that failed in the step before are tried again
with the next new ones, so nothing waits for them; after ``most`` attempts a job is dead and only listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import ship
from docweave.streaming.jobs import run_available

OUTCOMES = "id long, payload string, attempt int, result string, error string, step long"
#: Rounds of retries that a batch may be followed by.
_ROUNDS = 1000


def _outcomes(classify: Callable[[int, str, int], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(job: tuple) -> tuple[str | None, str | None]:
        try:
            return classify(*job), None
        except Exception as e:  # of any kind: it is this job's outcome
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs in frames:
            done = [one(j) for j in zip(jobs["id"].tolist(), jobs["payload"].tolist(), jobs["attempt"].tolist(), strict=True)]
            yield jobs.assign(result=[r for r, _ in done], error=[e for _, e in done])

    return run


@dataclass
class Drain:
    spark: SparkSession
    folder: str
    classify: Callable[[int, str, int], str]
    most: int = 3

    def outcomes(self) -> DataFrame:
        try:
            return self.spark.read.schema(OUTCOMES).parquet(f"{self.folder}/outcomes")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], OUTCOMES)

    def results(self) -> DataFrame:
        """(id, result) of the jobs that are done."""
        return self.outcomes().where("error is null").select("id", "result")

    def dead(self) -> DataFrame:
        """(id, payload, attempt, error) of the jobs that failed for good."""
        return self.outcomes().where(F.col("error").isNotNull() & (F.col("attempt") >= self.most)).select("id", "payload", "attempt", "error")

    def _failed_before(self, step: int) -> DataFrame:
        """Jobs to be tried again in a step: those that the last step before it saw fail with attempts left."""
        before = self.outcomes().where(F.col("step") < step)
        last = before.agg(F.max("step")).first()[0]
        if last is None:
            return before.select("id", "payload", "attempt")
        again = before.where((F.col("step") == last) & F.col("error").isNotNull() & (F.col("attempt") < self.most))
        return again.select("id", "payload", (F.col("attempt") + 1).alias("attempt"))

    def _step(self, step: int, jobs: DataFrame) -> None:
        tried = jobs.mapInPandas(_outcomes(self.classify), "id long, payload string, attempt int, result string, error string")
        tried.write.mode("overwrite").parquet(f"{self.folder}/outcomes/step={step}")

    def run(self, stream: DataFrame) -> None:
        """Works off what is on the stream (id, payload) now, batch by batch, then tries failed jobs until each is done or dead. A
        run that breaks off is continued by the next."""
        ship(self.spark)

        def each(batch: DataFrame, number: int) -> None:
            step = number * _ROUNDS
            new = batch.select("id", "payload", F.lit(1).alias("attempt"))
            self._step(step, new.unionByName(self._failed_before(step)))

        run_available(stream, f"{self.folder}/checkpoint", each).awaitTermination()
        for _ in range(self.most):
            last = self.outcomes().agg(F.max("step")).first()[0]
            if last is None or self._failed_before(last + 1).isEmpty():
                break
            self._step(last + 1, self._failed_before(last + 1))
