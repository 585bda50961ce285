"""Chunked duplicate search that can be stopped and continued.

A job lives in a folder that driver and executors share. Creating it writes the candidates and their fingerprints, ordered by id,
and those fingerprints that more than one candidate has, which alone can make groups.
Each step lands the next chunk of ids beside the stream's input and lets the stream work it off; the stream's checkpoint holds the
two smallest ids of every group as keyed state. What has been done follows from the folder alone, so a driver that dies at any
point, also between landing and working off, is followed by another that opens the same folder. Chunks come in the order of ids, so
the groups found so far are those of all files up to the cursor, whatever the size of the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import dedupe
from docweave.streaming import jobs, state

_FINGERPRINTS = "id long, strategy string, fingerprint string"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


@dataclass
class DedupeJob:
    spark: SparkSession
    folder: str
    chunk_size: int = 25
    max_groups: int | None = 25

    @classmethod
    def create(cls, files: DataFrame, contents: DataFrame, folder: str, *, strategies: list[str], namespaces: list[str] | None = None, path_scope: str | None = None, chunk_size: int = 25, max_groups: int | None = 25) -> DedupeJob:
        """A queued job over the candidates. ``max_groups`` None means no early stop."""
        job = cls(files.sparkSession, folder, chunk_size, max_groups)
        candidates = dedupe.candidates(files, namespaces=namespaces, path_scope=path_scope)
        parts = int(job.spark.conf.get("spark.sql.shuffle.partitions"))
        dedupe.fingerprints(candidates, contents, strategies).repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{folder}/fingerprints")
        # what no two candidates share never makes a group, so it takes no part in the stream and its state
        made = job.spark.read.parquet(f"{folder}/fingerprints")
        shared = made.groupBy("strategy", "fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        repeated = made.select("id", "strategy", "fingerprint").join(shared, ["strategy", "fingerprint"], "left_semi").select("id", "strategy", "fingerprint")
        repeated.repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{folder}/repeated")
        # written last: a job without candidates is not there yet
        candidates.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{folder}/candidates")
        return job

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _candidates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/candidates")

    def _cursor(self) -> int | None:
        return self._read("pages", "page long, high long").agg(F.max("high")).first()[0]

    def _land(self) -> bool:
        """Lands the next page: its fingerprints first, then the page itself, both replaced if they are landed again."""
        cursor = self._cursor()
        ahead = self._candidates() if cursor is None else self._candidates().where(F.col("id") > cursor)
        high = ahead.orderBy("id").limit(self.chunk_size).agg(F.max("id")).first()[0]
        if high is None:
            return False
        number = self._read("pages", "page long, high long").count()
        rows = self._read("repeated", _FINGERPRINTS).where(F.col("id") <= high)
        rows = rows if cursor is None else rows.where(F.col("id") > cursor)
        rows.select("id", "strategy", "fingerprint").coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/landed/n={number}")
        self.spark.createDataFrame([(number, high)], "page long, high long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pages/n={number}")
        return True

    def _work_off(self) -> None:
        stream = self.spark.readStream.schema(_FINGERPRINTS).parquet(f"{self.folder}/landed/*")
        found = state.second_members(stream)
        jobs.run_available(found, f"{self.folder}/state", jobs.append_batches(f"{self.folder}/seconds")).awaitTermination()

    def _seconds(self) -> DataFrame:
        """(strategy, fingerprint, second) of each group found."""
        found = self._read("seconds", "strategy string, fingerprint string, second long, batch long")
        return found.groupBy("strategy", "fingerprint").agg(F.min("second").alias("second"))

    def _end(self, n_groups: int) -> int | None:
        """The id at which the job stops early, if it does by now."""
        if self.max_groups is None or n_groups < self.max_groups:
            return None
        return self._seconds().orderBy("second", "strategy", "fingerprint").limit(self.max_groups).agg(F.max("second")).first()[0]

    def status(self) -> dict[str, object]:
        """status (queued, running or complete), cursor, processed_count, remaining_count and groups_found."""
        cursor, found = self._cursor(), self._seconds().count()
        end = self._end(found)
        at = cursor if end is None else end
        total, done = self._candidates().agg(F.count(F.lit(1)), F.count_if(F.col("id") <= at) if at is not None else F.lit(0)).first()
        status = "complete" if end is not None or done == total else "queued" if cursor is None else "running"
        groups = found if self.max_groups is None else min(found, self.max_groups)
        return {"status": status, "cursor": at, "processed_count": done, "remaining_count": total - done, "groups_found": groups}

    def advance(self, chunks: int = 1) -> dict[str, object]:
        """Works off what a dead driver left, then up to ``chunks`` chunks more, and returns the status. A complete job stays."""
        if self._cursor() is not None:
            self._work_off()
        for _ in range(chunks):
            if self._end(self._seconds().count()) is not None or not self._land():
                break
            self._work_off()
        return self.status()

    def found(self, job_id: str = "job") -> DataFrame:
        """The groups among the files processed so far."""
        at = self.status()["cursor"]
        rows = self.spark.read.parquet(f"{self.folder}/fingerprints")
        return dedupe.groups(rows.where(F.col("id") <= at) if at is not None else rows.limit(0), job_id=job_id)
