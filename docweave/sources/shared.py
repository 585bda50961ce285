"""Frames written to the folder that driver and executors share, to cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests), a folder of the warehouse in local mode."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_docweave_shared"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again: it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
