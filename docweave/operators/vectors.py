"""Similarity of stored vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        score = np.round(_unit(asked["vec"]) @ _unit(rows["vec"]).T, 9)
        ids, names = rows["id"].to_numpy(), asked["id"].to_numpy()
        score[names[:, None] == ids[None, :]] = -2.0
        parts = []
        for q, s in zip(names.tolist(), score, strict=True):
            at = np.lexsort((ids, -s))[:k]
            parts.append(pd.DataFrame({"query_id": q, "id": ids[at], "cosine": s[at]}))
        return pd.concat(parts).query("cosine > -2")

    return run


def cosine_topk(vectors: DataFrame, queries: Column, *, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, id, cosine, place): the nearest rows of each row (id, vec) for which ``queries`` holds. Queries and rows meet
    in blocks of bounded size; of each block only the best come back. Rows without a direction take no part."""
    known = vectors.where(F.col("id").isNotNull() & (F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) > 0))
    asked = known.where(queries)
    n_rows, n_asked = known.count(), asked.count()
    rows_in, asked_in = (max(1, -(-n // block)) for n in (n_rows, n_asked))
    one = asked.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(asked_in))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows_in - 1))))
    two = known.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(rows_in)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_in - 1).cast("long"))))
    found = one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInPandas(_best(k), "query_id long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)
