"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Fixed value: the same characters as a plain string.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own in local mode (tests) where it is
    unset. On a cluster it must be set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_docweave_checkpoints"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what is materialised inside when it ends. Frames made inside must have been consumed by then; take a path out of
    the list to keep it."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that does not clash, ignoring case, with the frame's own."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def renamed(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its columns named by their positions, so that no helper column clashes with one of them, and a function
    that gives a frame with some of these columns (and others) the old names back."""
    names = {f"c{i}_": c for i, c in enumerate(df.columns)}
    inside = df.toDF(*names)

    def back(done: DataFrame) -> DataFrame:
        return done.toDF(*(names.get(c, c) for c in done.columns))

    return inside, back


def shielded(**roles: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that carry columns: all but the columns that the parameters ``roles`` name (with these defaults) go in under
    names by position and come out under their own, so no helper column of the operator clashes with one. A carried column with
    the name of one that the operator adds is replaced."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(df: DataFrame, *args: object, **options: object) -> DataFrame:
            kept = {str(options.get(role, name)) for role, name in roles.items()}
            inside = [c if c in kept else f"c{i}_" for i, c in enumerate(df.columns)]
            names = {n: c for n, c in zip(inside, df.columns, strict=True) if n != c}
            done = operator(df.toDF(*inside), *args, **options)
            own = {c.lower() for c in done.columns if c not in names}
            return done.select(*(done[c].alias(names.get(c, c)) for c in done.columns if names.get(c, "").lower() not in own))

        return run

    return wrap


def byte_slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to about ``limit`` each (a single longer item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def texts_as_binary(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """The text column as UTF-8 bytes, null as empty."""
    return df.withColumn(out, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
