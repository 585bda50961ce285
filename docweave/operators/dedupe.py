"""Duplicate files by content or by name and size, with a recommended copy to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions import paths, text

#: Confidence and wording by strategy.
CONFIDENCE = {"exact_hash": 0.99, "content_hash": 0.93, "normalized_name_size": 0.55}
REASON = {
    "exact_hash": "Exact byte hash and size match across %d files.",
    "content_hash": "Extracted content hash and size match across %d files.",
    "normalized_name_size": "Normalized filename and size match across %d files; review before moving.",
}


def candidates(files: DataFrame, *, namespaces: list[str] | None = None, path_scope: str | None = None) -> DataFrame:
    rows = files.where(~F.col("is_deleted"))
    if namespaces:
        wanted = F.lit(False)
        for n in namespaces:
            wanted = wanted | F.col("path").like(f"/{n}/%")
        rows = rows.where(wanted)
    if path_scope:
        rows = rows.where(F.lower("path").like(f"%{path_scope.lower()}%"))
    return rows


def fingerprints(files: DataFrame, contents: DataFrame, strategies: list[str]) -> DataFrame:
    """One row a file and strategy that applies to it. Internal paths are left out. ``contents`` may have byte_hash, the hash of
    a live file's bytes, for ``exact_hash``."""
    known = contents.withColumnRenamed("file_id", "id")
    if "byte_hash" not in known.columns:
        known = known.withColumn("byte_hash", F.lit(None).cast("string"))
    rows = files.join(known.select("id", "content_hash", "byte_hash"), "id", "left").where(~paths.has_hidden_segment(F.col("path")))
    size = F.coalesce(F.col("size_bytes"), F.lit(0)).cast("string")
    name = F.nullif(text.normalized_name(F.col("name")), F.lit(""))
    raw = {"exact_hash": F.concat(F.col("byte_hash"), F.lit(":"), size), "content_hash": F.concat(F.col("content_hash"), F.lit(":"), size), "normalized_name_size": F.concat(name, F.lit(":"), size)}
    each = F.array_compact(F.array(*(F.when(raw[s].isNotNull(), F.struct(F.lit(s).alias("strategy"), F.sha2(F.concat(F.lit(f"{s}|"), raw[s]), 256).alias("fingerprint"))) for s in strategies)))
    kept = rows.select("id", "path", "size_bytes", "modified_at", F.explode(each).alias("f"))
    return kept.select("id", "path", "size_bytes", "modified_at", "f.strategy", "f.fingerprint")


def cut_after_groups(rows: DataFrame, most: int) -> DataFrame:
    """Rows up to the id at which the ``most``-th group gets its second member. Second members are found by two minima, so a
    large group is never gathered."""
    key = ["strategy", "fingerprint"]
    first = rows.groupBy(*key).agg(F.min("id").alias("first"))
    second = rows.join(first, key).where("id > first").groupBy(*key).agg(F.min("id").alias("second"))
    last = second.orderBy("second", *key).limit(most).agg(F.count(F.lit(1)).alias("n"), F.max("second").alias("cut"))
    return rows.crossJoin(F.broadcast(last)).where((F.col("n") < most) | (F.col("id") <= F.col("cut"))).drop("n", "cut")


def _best() -> list[Column]:
    modified = F.coalesce(F.unix_timestamp("modified_at"), F.lit(0))
    return [modified.desc(), paths.is_backup(F.col("path")).asc(), F.length("path").asc(), F.lower("path").asc(), F.col("id").asc()]


def groups(rows: DataFrame, *, job_id: str = "job") -> DataFrame:
    """Groups of two or more with counts, sizes, confidence, wording and the copy to keep: newest, not a backup, shortest path,
    first path, smallest id."""
    key = ["strategy", "fingerprint"]
    modified = F.coalesce(F.unix_timestamp("modified_at"), F.lit(0))
    order = F.struct((-modified).alias("a"), paths.is_backup(F.col("path")).alias("b"), F.length("path").alias("c"), F.lower("path").alias("d"), F.col("id").alias("id"))
    found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("long").alias("total_size_bytes"), F.min(order).alias("best")).where("members > 1")
    confidence = F.lit(None).cast("double")
    reason = F.lit(None).cast("string")
    for s in CONFIDENCE:
        confidence = F.when(F.col("strategy") == s, F.lit(CONFIDENCE[s])).otherwise(confidence)
        reason = F.when(F.col("strategy") == s, F.format_string(REASON[s], "members")).otherwise(reason)
    ident = text.sha_prefix(F.concat_ws("|", F.lit(job_id), "strategy", "fingerprint"))
    return found.select(ident.alias("group_id"), *key, (F.col("members") - 1).alias("duplicate_count"), "total_size_bytes", F.col("best.id").alias("keep_id"), confidence.alias("confidence"), reason.alias("reason"))


def members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Members of groups with their role and the action proposed for them."""
    both = rows.join(found.select("strategy", "fingerprint", "group_id", "keep_id"), ["strategy", "fingerprint"])
    keep = F.col("id") == F.col("keep_id")
    role = F.when(keep, "canonical").otherwise("duplicate")
    action = F.when(keep, "keep").when(F.col("strategy").isin("exact_hash", "content_hash"), "move_to_backup").otherwise("review")
    return both.select("group_id", "strategy", "id", "path", role.alias("role"), action.alias("action"))


def run(files: DataFrame, contents: DataFrame, *, strategies: list[str], max_groups: int | None = 25, namespaces: list[str] | None = None, path_scope: str | None = None) -> DataFrame:
    """Groups of a whole run. ``max_groups`` (1 to 200; None becomes 25) stops it early."""
    rows = fingerprints(candidates(files, namespaces=namespaces, path_scope=path_scope), contents, strategies)
    return groups(cut_after_groups(rows, min(200, max(1, 25 if max_groups is None else max_groups))))


def run_all(files: DataFrame, contents: DataFrame, *, strategies: list[str], namespaces: list[str] | None = None, path_scope: str | None = None) -> DataFrame:
    """Groups over all files, without an early stop."""
    return groups(fingerprints(candidates(files, namespaces=namespaces, path_scope=path_scope), contents, strategies))


def list_groups(found: DataFrame, *, min_group_size: int = 2, strategy: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = found.where(F.col("duplicate_count") >= max(min_group_size - 1, 1))
    if strategy:
        rows = rows.where(F.col("strategy") == strategy)
    return rows.orderBy(F.desc("total_size_bytes"), "group_id").offset(max(offset, 0)).limit(min(100, max(1, limit)))


def apply_errors(moves: DataFrame, found: DataFrame, *, least_confidence: float = 0.9) -> DataFrame:
    """Why each asked move (group_id, keep_id, move_ids) may not be done; null where it may."""
    both = moves.alias("m").join(found.alias("g"), "group_id", "left")
    why = (
        F.when(F.col("g.strategy").isNull(), "unknown group")
        .when(F.col("g.confidence") < least_confidence, "confidence too low")
        .when(F.col("m.keep_id") != F.col("g.keep_id"), "not the recommended keep")
        .when(F.array_contains("m.move_ids", F.col("m.keep_id")), "keep is in the move list")
    )
    return both.select("group_id", why.alias("error"))


def legacy_groups(files: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """Groups by hash and size where the limit cuts sorted fingerprints before groups of one are dropped."""
    rows = files.where(~F.col("is_deleted")).join(contents.withColumnRenamed("file_id", "id"), "id").where("content_hash is not null")
    key = F.concat_ws(":", "content_hash", F.coalesce(F.col("size_bytes"), F.lit(0)))
    lowest = F.min(F.struct(F.lower("path").alias("p"), F.col("id").alias("id")))
    return rows.groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("members"), lowest.alias("best")).orderBy("fingerprint").limit(limit).where("members > 1").select("fingerprint", "members", F.col("best.id").alias("canonical_id"))


def ranked_copies(rows: DataFrame) -> DataFrame:
    """Every member with its place in its group's order of preference."""
    order = Window.partitionBy("strategy", "fingerprint").orderBy(*_best())
    return rows.withColumn("place", F.row_number().over(order))
