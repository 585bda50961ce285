"""Reconciling snapshots and matching notes to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions.ranks import numbered

_FIELDS = ("name", "path", "mime_type", "extension", "size_bytes", "modified_at")


def reconcile_snapshot(files: DataFrame, seen: DataFrame, *, complete: bool) -> DataFrame:
    """The index after a crawl. Items seen are inserted or updated, and come back if they were deleted; after a complete
    snapshot, what was not seen is marked deleted. ``change`` says what happened."""
    old = files.select("external_id", *(F.col(f).alias(f"old_{f}") for f in _FIELDS), F.col("is_deleted").alias("was_deleted"), F.lit(True).alias("known"))
    new = seen.select("external_id", *(F.col(f).alias(f"new_{f}") for f in _FIELDS), F.lit(True).alias("met"))
    both = old.join(new, "external_id", "full_outer")
    known, met = F.coalesce("known", F.lit(False)), F.coalesce("met", F.lit(False))
    gone = ~met & F.lit(complete) & ~F.coalesce("was_deleted", F.lit(False))
    differs = reduce(lambda a, b: a | b, (~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")) for f in _FIELDS))
    change = F.when(~known, "inserted").when(met & F.col("was_deleted"), "restored").when(met & differs, "updated").when(gone, "deleted").otherwise("unchanged")
    values = [F.when(met, F.col(f"new_{f}")).otherwise(F.col(f"old_{f}")).alias(f) for f in _FIELDS]
    return both.select("external_id", *values, (~met & (F.lit(complete) | F.coalesce("was_deleted", F.lit(False)))).alias("is_deleted"), change.alias("change"))


def replace_texts(contents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Texts after extraction: failures keep the old text, empty texts drop it, others replace it."""
    new = extracted.select("file_id", F.col("content_text").alias("new_text"), F.col("failed"), F.lit(True).alias("met"))
    both = contents.select("file_id", F.col("content_text").alias("old_text")).join(new, "file_id", "full_outer")
    fresh = F.coalesce("met", F.lit(False)) & ~F.coalesce("failed", F.lit(False))
    value = F.when(fresh, F.nullif("new_text", F.lit(""))).otherwise(F.col("old_text"))
    return both.select("file_id", value.alias("content_text")).where("content_text is not null").withColumn("content_hash", F.sha2("content_text", 256))


def cascading_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left row (lid) with the right rows (rid) of the first key that finds any. One equi-join a key, and only rows that
    no key before has matched go into the next."""
    found = None
    for rank, key in enumerate(keys):
        part = left.select("lid", key).join(right.select("rid", key), key).select("lid", "rid", F.lit(rank).alias("rank")).distinct()
        found = part if found is None else found.union(part)
        if rank + 1 < len(keys):
            left = left.join(right.select(key).distinct(), key, "left_anti")
    return found


def unique_or_ambiguous(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each left row: the single right row of the first key that finds any, or ambiguous, or missing."""
    out = left.select("lid", *keys)
    for i, key in enumerate(keys):
        grouped = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"n{i}"), F.min("rid").alias(f"r{i}"))
        out = out.join(grouped, key, "left")
    status, chosen = F.lit("missing"), F.lit(None).cast("long")
    for i in reversed(range(len(keys))):
        status = F.when(F.col(f"n{i}") == 1, "repair").when(F.col(f"n{i}") > 1, "ambiguous").otherwise(status)
        chosen = F.when(F.col(f"n{i}") == 1, F.col(f"r{i}")).when(F.col(f"n{i}") > 1, F.lit(None)).otherwise(chosen)
    return out.select("lid", status.alias("status"), chosen.alias("rid"))


def latest_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """The label of the latest override (seq) of each row's path, or else of its name."""
    by = {}
    for key in ("path", "name"):
        by[key] = overrides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("label", "seq").alias(f"{key}_label"))
    return rows.join(by["path"], "path", "left").join(by["name"], "name", "left").select("id", F.coalesce("path_label", "name_label").alias("label"))


def first_of_namespaces(paths: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """The file a relative path names under the first root that has it."""
    out = paths
    for i, root in enumerate(roots):
        side = files.select(F.col("path").alias(f"p{i}"), F.col("id").alias(f"i{i}"))
        out = out.join(side, F.concat(F.lit(f"/{root}/"), F.col("relative_path")) == F.col(f"p{i}"), "left")
    return out.select("relative_path", F.coalesce(*(F.col(f"i{i}") for i in range(len(roots)))).alias("id"))


def folder_label(parts: Column, labels: dict[str, str]) -> Column:
    """The label of the longest folder suffix that the map (joined by /) knows."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.get(F.filter(F.transform(suffixes, lambda s: known[s]), lambda v: v.isNotNull()), F.lit(0))


def restore_plan(changes: DataFrame) -> DataFrame:
    """The latest change of each path."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("id")))).where("place = 1").drop("place")


def _split_name(name: str) -> tuple[Column, Column]:
    """Stem and extension (with its dot). Leading dots belong to the stem."""
    whole = r"(?s)^(\.*[^.].*)(\.[^.]*)$"
    cut = F.col(name).rlike(whole)
    return F.when(cut, F.regexp_extract(name, whole, 1)).otherwise(F.col(name)), F.when(cut, F.regexp_extract(name, whole, 2)).otherwise("")


def sequence_of_names(rows: DataFrame, existing: DataFrame | None = None, *, block: int = 1024) -> DataFrame:
    """(id, unique_name): names (id, name) made unique among each other and against ``existing`` (name). The first row of a name, by id,
    keeps it unless it exists; all others get ``stem (n).ext`` with the free numbers from 2 on, in order of id. Names that rows
    have of their own or that exist are never given to another row, so none repeats.

    The r-th row in need of a number gets r + 1 plus the taken numbers before it. A taken number t, the j-th of its name, lies before
    all rows from r = t - j on. Rows are cut into blocks of numbers, so a common name is spread over tasks."""
    held = rows.select("name").distinct()
    known = held if existing is None else held.union(existing.select("name")).distinct()
    lowest = rows.groupBy("name").agg(F.min("id").alias("first"))
    if existing is not None:
        lowest = lowest.join(existing.select("name").distinct(), "name", "left_anti")
    owners = lowest.select(F.col("name").alias("own_name"), "first")
    both = rows.join(owners, (F.col("name") == F.col("own_name")) & (F.col("id") == F.col("first")), "left")
    keeps = both.where("first is not null").select("id", F.col("name").alias("unique_name"))
    asks = numbered(both.where("first is null").select("id", "name"), "name", "id", "r").withColumn("block", F.floor(F.col("r") / block))

    stem, extension = _split_name("name")
    parts = known.select(stem.alias("stem"), extension.alias("extension"))
    made = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,8})\)$"
    taken = parts.where(F.col("stem").rlike(made)).select(F.concat(F.regexp_extract("stem", made, 1), "extension").alias("name"), F.regexp_extract("stem", made, 2).cast("long").alias("t"))
    gaps = numbered(taken, "name", "t", "j").select("name", (F.col("t") - F.col("j")).alias("r")).groupBy("name", "r").agg(F.count(F.lit(1)).alias("n"))
    gaps = gaps.withColumn("block", F.floor(F.col("r") / block))

    blocks = asks.select("name", "block", F.lit(0).alias("n")).distinct().union(gaps.select("name", "block", "n")).groupBy("name", "block").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("name", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    merged = asks.select("name", "block", "r", "id", F.lit(0).cast("long").alias("n")).union(gaps.select("name", "block", "r", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "n"))
    within = F.sum("n").over(Window.partitionBy("name", "block").orderBy("r").rangeBetween(Window.unboundedPreceding, 0))
    placed = merged.withColumn("within", within).where("id is not null").join(before, ["name", "block"])
    number = (F.col("r") + 1 + F.col("before") + F.col("within")).cast("string")
    given = placed.select("id", F.concat(stem, F.lit(" ("), number, F.lit(")"), extension).alias("unique_name"))
    return keeps.union(given)
