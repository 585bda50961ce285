"""Compares a query's rows with those of its DuckDB equivalent."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from pyspark.sql import DataFrame


def canonical(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())


def duck_rows(sql: str, data: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    return names, sorted(tuple(canonical(r[columns.index(c)]) for c in names) for r in found.fetchall())
