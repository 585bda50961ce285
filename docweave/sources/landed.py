"""Landed messages as a stream whose offset is the last date seen, with an overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from docweave.session import ship

DATE = "internal_date_ms"


@dataclass
class _Piece(InputPartition):
    path: str
    group: int
    since: int
    until: int


class _Reader(DataSourceStreamReader):
    """Offsets are dates in milliseconds. A batch reads what is dated from the overlap before its start to its end."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.overlap = options["path"], int(options.get("overlapMs", "1000"))
        self.names = schema.fieldNames()
        self.footers: dict[str, list[tuple[int, int, int]]] = {}

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(file, row group, least date, largest date), from the footers of the files; each is read once."""
        fs, root = FileSystem.from_uri(self.path)
        for info in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not info.base_name.endswith(".parquet") or info.base_name[0] in "._":
                continue
            if info.path not in self.footers:
                self.footers[info.path] = self._dates(fs, info.path)
            for group, low, high in self.footers[info.path]:
                yield info.path, group, low, high

    @staticmethod
    def _dates(fs: FileSystem, path: str) -> list[tuple[int, int, int]]:
        with fs.open_input_file(path) as held:
            file = pq.ParquetFile(held)
            at = file.schema_arrow.names.index(DATE)
            found = []
            for group in range(file.metadata.num_row_groups):
                stats = file.metadata.row_group(group).column(at).statistics
                if stats is not None and stats.has_min_max:
                    found.append((group, stats.min, stats.max))
                    continue
                dates = pc.min_max(file.read_row_group(group, columns=[DATE])[DATE]).as_py()  # a footer without statistics
                if dates["max"] is not None:
                    found.append((group, dates["min"], dates["max"]))
            return found

    def initialOffset(self) -> dict[str, int]:
        return {"at": 0}

    def latestOffset(self) -> dict[str, int]:
        return {"at": max((high for _, _, _, high in self._groups()), default=0)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        since, until = (start["at"] - self.overlap if start["at"] > 0 else 0), end["at"]
        return [_Piece(path, group, since, until) for path, group, low, high in self._groups() if high >= since and low <= until]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as held:
            columns = list(dict.fromkeys([*self.names, DATE]))
            for batch in pq.ParquetFile(held).iter_batches(row_groups=[partition.group], columns=columns):
                dates = batch.column(batch.schema.get_field_index(DATE))
                kept = batch.filter(pc.and_(pc.greater_equal(dates, partition.since), pc.less_equal(dates, partition.until)))
                if kept.num_rows:
                    yield kept.select(self.names)

    def commit(self, end: dict[str, int]) -> None:
        return None


class LandedMessages(DataSource):
    """Format ``landed_messages``: Parquet files below ``path`` with a long ``internal_date_ms``, read by a given schema."""

    @classmethod
    def name(cls) -> str:
        return "landed_messages"

    def streamReader(self, schema: StructType) -> Any:
        return _Reader(dict(self.options), schema)


def messages_since(spark: SparkSession, path: str, schema: str, *, key: str = "id", overlap_ms: int = 1000) -> DataFrame:
    """A stream of landed messages, each key once, with ``sent_at``. A restart goes on at the last date of its checkpoint less
    the overlap; what the overlap brings again is dropped, what lands late but within it is not lost. Messages that land with a
    date before the overlap are not seen any more, like those without a date or with one before 1970. The schema names the key and
    ``internal_date_ms``. Files must stay where they are while a batch may be run again; executors see the same ``path``, which
    is one of the file systems of pyarrow. The driver reads footers only, each file's once."""
    ship(spark)
    spark.dataSource.register(LandedMessages)
    read = spark.readStream.format("landed_messages").schema(schema).option("path", path).option("overlapMs", str(overlap_ms)).load()
    dated = read.withColumn("sent_at", F.timestamp_millis(DATE))
    return dated.withWatermark("sent_at", f"{overlap_ms + 1000} milliseconds").dropDuplicatesWithinWatermark([key])
