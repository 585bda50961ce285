"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _part(rows: DataFrame, order: str, parts: int) -> Column:
    bounds = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)))
    held = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(held, lambda b: b < F.col(order).cast("double")))


def numbered(rows: DataFrame, group: str, order: str, name: str, *, parts: int = 64) -> DataFrame:
    """Adds the number of each row, from 1, within its group in the order of a numeric column. Rows are cut into ``parts`` ranges
    of that column, numbered within them, and shifted by the counts of the ranges before, so that no task holds a whole group."""
    cut = rows.withColumn("__part", _part(rows, order, parts))
    counts = cut.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__rows"))
    ahead = Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__group", "__of", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order))
    joined = cut.withColumn("__own", own).join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return joined.select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))


def followed(rows: DataFrame, group: str, order: str, names: list[str], *, parts: int = 64) -> DataFrame:
    """Adds ``next``, the named columns of the next row of the group in the order of a numeric column (null for the last). Rows are
    cut into ranges as in ``numbered``; the last of a range looks at the first of the next range that has rows of its group."""
    cut = rows.withColumn("__part", _part(rows, order, parts))
    value = F.struct(*names)
    firsts = cut.groupBy(group, "__part").agg(F.min_by(value, order).alias("__first"))
    later = Window.partitionBy(group).orderBy("__part")
    after = firsts.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.lead("__first").over(later).alias("__after"))
    own = F.lead(value).over(Window.partitionBy(group, "__part").orderBy(order))
    joined = cut.withColumn("__own", own).join(after, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return joined.select(*rows.columns, F.coalesce("__own", "__after").alias("next"))
