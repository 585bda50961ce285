"""Versioned tables of keyed rows: copy-on-write upserts over hash buckets, switched by a manifest.

A table is a folder. ``files`` holds Parquet by write and bucket, ``manifests`` one small JSON file a version: which folder holds
each bucket, and the names of the batches applied. An upsert reads and rewrites the buckets that its rows fall in, and no others; the
new version begins to exist when its manifest is renamed into place. A run that fails before that leaves the old version as it
was (and files that ``vacuum`` removes), and of two writers at a time one fails and may try again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionTaken(RuntimeError):
    """Another writer has made the next version."""


@dataclass
class VersionedTable:
    spark: SparkSession
    folder: str
    key: str
    buckets: int
    schema: str

    def _path(self, *parts: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self) -> object:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path = self._path("manifests")
        if not self._fs().exists(path):
            return []
        names = (s.getPath().getName() for s in self._fs().listStatus(path))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "places": {bucket: folder}, "batches"} of a version, by default the newest."""
        known = self.versions()
        if not known:
            return {"version": 0, "places": {}, "batches": []}
        stream = self._fs().open(self._path("manifests", f"{known[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs = self._fs()
        draft, final = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", f"{manifest['version']}.json")
        out = fs.create(draft)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise VersionTaken(f"version {manifest['version']} of {self.folder}")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        places = self.manifest(version)["places"]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/files/{place}/bucket={b}" for b, place in places.items()]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, rows: DataFrame, *, latest: str | None = None, batch: str | None = None) -> int:
        """Puts ``rows`` in the place of rows with their keys, or adds them, and returns the version that holds them. Of rows with
        one key the one with the largest ``latest`` counts (else, or among equals, the largest by its columns). A batch that was
        applied before, by its name, changes nothing. Null is a key like others."""
        now = self.manifest()
        if batch is not None and batch in now["batches"]:
            return now["version"]
        names = self.spark.createDataFrame([], self.schema).columns
        order = F.struct(*([F.col(latest).alias("latest_")] if latest else []), *(F.col(c).alias(c) for c in names))
        new = rows.groupBy(self.key).agg(F.max(order).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in names))
        new = new.withColumn("bucket", self._bucket(F.col(self.key)))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched and batch is None:
            return now["version"]
        write = uuid.uuid4().hex
        if touched:
            held = [f"{self.folder}/files/{place}/bucket={b}" for b, place in now["places"].items() if int(b) in touched]
            merged = new
            if held:
                old = self.spark.read.schema(self.schema).parquet(*held)
                kept = old.join(new.select(F.col(self.key).alias("new_key")), F.col(self.key).eqNullSafe(F.col("new_key")), "left_anti")
                merged = new.unionByName(kept.withColumn("bucket", self._bucket(F.col(self.key))))
            merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.folder}/files/{write}")
        places = now["places"] | {str(b): write for b in touched}
        self._commit({"version": now["version"] + 1, "places": places, "batches": now["batches"] + ([batch] if batch is not None else [])})
        return now["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions but the newest ``keep``, and files that none of those holds. Returns how many folders went."""
        known = self.versions()
        for version in known[: max(0, len(known) - keep)]:
            self._fs().delete(self._path("manifests", f"{version}.json"), False)
        used = {(place, str(b)) for v in known[-keep:] for b, place in self.manifest(v)["places"].items()}
        gone = 0
        if self._fs().exists(self._path("files")):
            for write in self._fs().listStatus(self._path("files")):
                for bucket in self._fs().listStatus(write.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and (write.getPath().getName(), name.removeprefix("bucket=")) not in used:
                        gone += bool(self._fs().delete(bucket.getPath(), True))
        return gone
