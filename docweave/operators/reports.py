"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions import paths


def counts_by(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Number of rows by a key; null and blank keys are left out."""
    return df.select(key.cast("string").alias(name)).where(F.trim(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def provider_counts(files: DataFrame) -> DataFrame:
    return counts_by(files.where(~F.col("is_deleted")), paths.provider(F.col("path")), "provider")


def mixed_counters(df: DataFrame, deleted: Column, kind: Column) -> DataFrame:
    """total, deleted and type:<kind> in long form, from one pass of grouped partial counts."""
    per = df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(deleted).alias("gone"))
    rows = per.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.col("n").alias("n")), F.struct(F.lit("deleted").alias("metric"), F.col("gone").alias("n")), F.struct(F.concat(F.lit("type:"), F.col("kind")).alias("metric"), (F.col("n") - F.col("gone")).alias("n")))).alias("r"))
    return rows.select("r.*").where("metric is not null").groupBy("metric").agg(F.sum("n").alias("n"))


def zero_filled(df: DataFrame, key: Column, domain: list[str]) -> DataFrame:
    """One row of counts over a fixed domain."""
    return df.agg(*(F.count_if(key == d).alias(d) for d in domain))


def json_object(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: a JSON object of key and value, keys in order."""
    entries = F.sort_array(F.collect_list(F.struct(key.cast("string").alias("key"), value.alias("value"))))
    return df.agg(F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}")).alias("json"))


def most_common(df: DataFrame, key: Column, seq: Column, k: int) -> DataFrame:
    """The k commonest keys; ties go to the one met first."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first")).where("key is not null").orderBy(F.desc("n"), "first").limit(k).select("key", "n")


def co_occurrence(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k commonest keys of each group, ties by key."""
    counted = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), key))).where(F.col("place") <= k)


def long_report(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Counts of several columns at once: (metric, key, n), one scan and one shuffle of partial counts."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("string").alias("key")) for m, c in metrics.items()))).alias("r")).select("r.*")
    return rows.where("key is not null").groupBy("metric", "key").agg(F.count(F.lit(1)).alias("n"))


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def readiness(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row of counts and rates of reviewed rows (file, extension, label, approved, agrees), and ordered warnings."""
    agg = rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("file").alias("files"),
        F.countDistinct("extension").alias("extensions"),
        F.countDistinct("label").alias("labels"),
        F.count_if("approved").alias("approved"),
        F.count_if("agrees").alias("agreeing"),
    ).withColumns({"approval_rate": rate(F.col("approved"), F.col("samples")), "agreement_rate": rate(F.col("agreeing"), F.col("approved"))})
    warnings = F.array_compact(F.array(*(F.when(F.col(c) < t, F.lit(f"{c}<{t:g}")) for c, t in thresholds.items())))
    return agg.withColumn("warnings", warnings).withColumn("ready", F.size("warnings") == 0)


def pair_disagreements(feeds: list[DataFrame], least: int) -> DataFrame:
    """first|second keys of several feeds with their summed counts, from ``least`` up."""
    rows = feeds[0].select("first", "second")
    for f in feeds[1:]:
        rows = rows.unionByName(f.select("first", "second"))
    return rows.groupBy(F.concat_ws("|", "first", "second").alias("pair")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def bucketed(df: DataFrame, status: Column, item: Column, domain: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each batch (``by``): count and sorted list of items of each status of a fixed domain."""
    cols = []
    for d in domain:
        cols += [F.count_if(status == d).alias(f"{d}_count"), F.sort_array(F.collect_list(F.when(status == d, item))).alias(f"{d}_items")]
    return df.groupBy(*(by or [])).agg(*cols)


def rollup_status(remotes: DataFrame) -> DataFrame:
    """One row from (remote, required, ok): remotes that failed, required ones among them, and the overall status."""
    out = remotes.agg(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("remote")))).alias("degraded"), F.sort_array(F.collect_list(F.when(~F.col("ok") & F.col("required"), F.col("remote")))).alias("required_failures"))
    return out.withColumn("status", F.when(F.size("required_failures") > 0, "failed").when(F.size("degraded") > 0, "degraded").otherwise("ok"))


#: What a generated note says of its origin.
CONTEXT = ["source_parser", "heuristic_primary_hint", "hybrid_live_source"]


def note_context_gaps(notes: DataFrame, files: DataFrame, states: DataFrame, *, root: str) -> DataFrame:
    """One row of counters over generated notes (the columns of CONTEXT and canonical_source_path): how many there are, how many
    miss some or each of the context values (null or blank), and of those whether their source is a live file and how far the files
    of its path are: one is completed, else one is queued, else there is another state, else none. Sources are absolute paths below
    ``root``; files have the path below it, and there may be several of a path, deleted ones included."""
    known = states.where("submission_status is not null").select(F.col("file_id").alias("id"), "submission_status")
    status = F.col("submission_status")
    per_path = files.join(known, "id", "left").where("path is not null").groupBy("path").agg(
        F.max(~F.col("is_deleted")).alias("live"), F.count(status).alias("states"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "queued").alias("queued")
    )
    missing = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in CONTEXT}
    source = F.replace(F.trim("canonical_source_path"), F.lit("\\"), F.lit("/"))
    below = F.when(source.startswith(f"{root}/"), F.substring(source, F.lit(len(root) + 1), F.length(source)))
    rows = notes.select(below.alias("path"), *(m.alias(c) for c, m in missing.items())).withColumn("any", F.greatest(*CONTEXT))
    found = rows.join(per_path, "path", "left")
    gap, held = F.col("any"), lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    live = F.coalesce(F.col("live"), F.lit(False))
    counters = {
        "total_generated_notes": F.lit(True),
        "notes_missing_any_context": gap,
        **{f"notes_missing_{c}": F.col(c) for c in CONTEXT},
        "missing_context_with_matching_completed_state": gap & held("completed"),
        "missing_context_with_matching_queued_state": gap & held("queued") & ~held("completed"),
        "missing_context_with_matching_other_state": gap & held("states") & ~held("completed") & ~held("queued"),
        "missing_context_without_matching_state": gap & ~held("states"),
        "missing_context_source_file_present": gap & live,
        "missing_context_source_file_missing": gap & ~live,
    }
    return found.agg(*(F.count_if(c).alias(name) for name, c in counters.items()))
