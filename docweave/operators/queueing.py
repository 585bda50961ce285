"""Queue analytics over files, states and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths

#: Extensions that the classifier takes.
DOCUMENTS = ["pdf", "doc", "docx", "xls", "xlsx", "csv", "tsv", "ppt", "pptx", "txt", "md", "rtf", "html", "htm"]
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]
BUCKETS = {"document": 0, "text-backed": 1, "image": 2, "other": 3}
ACTIVE = ["queued", "running"]


def source_fingerprint(content_hash: Column, path: Column, mime: Column, size: Column, modified: Column) -> Column:
    filled = F.when(size != 0, size.cast("string")).otherwise(F.lit(""))
    when = F.coalesce(F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss+00:00"), F.lit(""))
    meta = F.sha2(F.concat_ws("|", path, mime, F.coalesce(filled, F.lit("")), when), 256)
    return F.when(F.coalesce(content_hash, F.lit("")) != "", F.concat(F.lit("text:"), content_hash)).otherwise(F.concat(F.lit("meta:"), meta))


def bucket(ext: Column, content_hash: Column) -> Column:
    return F.when(ext.isin(DOCUMENTS), "document").when(F.coalesce(content_hash, F.lit("")) != "", "text-backed").when(ext.isin(IMAGES), "image").otherwise("other")


def bucket_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for b, r in BUCKETS.items():
        out = F.when(name == b, r).otherwise(out)
    return out


def needs_work(files: DataFrame, contents: DataFrame, states: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files that are neither done at their present fingerprint, nor in an ignored folder, nor in an active job."""
    rows = files.where(~F.col("is_deleted") & ~paths.in_ignored_folder(F.col("path")))
    rows = rows.join(contents.select(F.col("file_id").alias("id"), "content_hash"), "id", "left")
    done = states.where("submission_status = 'completed'").select(F.col("file_id").alias("id"), "source_fingerprint")
    fp = source_fingerprint(F.col("content_hash"), F.col("path"), F.col("mime_type"), F.col("size_bytes"), F.col("modified_at"))
    rows = rows.withColumn("fingerprint", fp).join(done, "id", "left")
    rows = rows.where(F.col("source_fingerprint").isNull() | (F.col("source_fingerprint") != F.col("fingerprint")))
    active = jobs.where(F.col("status").isin(ACTIVE)).select(F.col("file_id").alias("id"))
    return rows.join(active, "id", "left_anti").withColumn("bucket", bucket(F.col("extension"), F.col("content_hash")))


def enqueue_plan(files: DataFrame, contents: DataFrame, states: DataFrame, jobs: DataFrame, limit: int, *, strict: bool = True) -> DataFrame:
    """The first ``limit`` files to queue, by bucket and id. ``strict`` keeps the original's behaviour that only documents and
    images without text are ever candidates; without it all buckets are filled."""
    rows = needs_work(files, contents, states, jobs)
    if strict:
        rows = rows.where(F.col("bucket").isin("document", "image"))
    return rows.select("id", "bucket", bucket_rank(F.col("bucket")).alias("rank"), "fingerprint").orderBy("rank", "id").limit(limit)


def claim_next(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    due = (F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return jobs.where(due).orderBy("priority_rank", "id").limit(n)


def recover_stale(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs without a heartbeat since the cutoff are queued again."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < cutoff))
    return jobs.withColumn("status", F.when(stale, "queued").otherwise(F.col("status"))).withColumn("heartbeat_at", F.when(stale, F.lit(None)).otherwise(F.col("heartbeat_at")))


def retry_outcome(attempts: Column, most: Column, permanent: Column, now: Column, backoff_seconds: int = 60) -> Column:
    """Struct of status, attempts and next_attempt_at after a failure; the wait doubles each time."""
    n = attempts + 1
    over = permanent | (n >= most)
    wait = F.make_interval(secs=F.lit(backoff_seconds) * F.pow(F.lit(2), attempts))
    return F.struct(F.when(over, "failed").otherwise("queued").alias("status"), n.alias("attempts"), F.when(~over, now + wait).alias("next_attempt_at"))


def latest(jobs: DataFrame) -> DataFrame:
    """The row with the largest id."""
    return jobs.orderBy(F.desc("id")).limit(1)


def queue_once(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requests whose key is neither known nor met before (smallest id first)."""
    first = wanted.groupBy(key).agg(F.min("id").alias("id"))
    return wanted.join(first, [key, "id"], "left_semi").join(known.select(key), key, "left_anti")


def progress_step(matched: DataFrame, cursor: int, size: int = 25) -> DataFrame:
    """The next ids after a cursor, at most 25."""
    return matched.where(F.col("id") > cursor).orderBy("id").limit(min(25, max(1, size)))


def requeue_targets(feedback: DataFrame, states: DataFrame, limit: int) -> DataFrame:
    """Files whose latest feedback is newer than their last completion and names another label."""
    newest = feedback.groupBy("file_id").agg(F.max_by("label", F.struct("recorded_at", "id")).alias("label"), F.max("recorded_at").alias("recorded_at"))
    both = newest.join(states.select("file_id", "primary_label", "completed_at"), "file_id")
    return both.where("recorded_at > completed_at and label <> primary_label").select("file_id", "label", "primary_label", F.lit(-1).alias("rank")).orderBy("file_id").limit(limit)


#: Parts of paths of messages, and the folder of notes that wait for a review.
MESSAGE_MARKERS = ["/text messages/", "/messenger/", "/your_facebook_activity/messages/", "your_messages.html", "/sms/"]
REVIEW_NOTES = "/vault/02 Needs Review/"


def requeue_all(feedback: DataFrame, files: DataFrame, states: DataFrame, jobs: DataFrame, limit: int) -> DataFrame:
    """(file_id, feed), the first ``limit`` files to classify again, none of them in an active job: first (feed 0) those whose
    latest feedback names another label than their state and is newer than its completion, if there is one; then (feed 1) live
    completed messages without a label or with a note that waits for a review. Each by id."""
    newest = feedback.where(F.trim("label") != "").groupBy("file_id").agg(F.max_by("label", F.struct("recorded_at", "id")).alias("label"), F.max("recorded_at").alias("recorded_at"))
    known = states.select("file_id", "primary_label", "completed_at", "submission_status", "classifier_note_path")
    own = newest.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").join(known, "file_id", "left")
    current = F.trim(F.coalesce("primary_label", F.lit("")))
    told = own.where((F.col("completed_at").isNull() | (F.col("recorded_at") > F.col("completed_at"))) & (F.trim("label") != current))
    path = F.lower(F.coalesce("path", F.lit("")))
    message = F.exists(F.array(*map(F.lit, MESSAGE_MARKERS)), lambda m: F.contains(path, m))
    live = files.where(~F.coalesce("is_deleted", F.lit(False)) & F.col("extension").isin(DOCUMENTS + IMAGES) & message).select(F.col("id").alias("file_id"))
    waiting = F.coalesce(F.col("classifier_note_path").startswith(REVIEW_NOTES), F.lit(False))
    unlabelled = live.join(known.where((F.col("submission_status") == "completed") & ((current == "") | waiting)), "file_id")
    rows = told.select("file_id", F.lit(0).alias("feed")).unionByName(unlabelled.select("file_id", F.lit(1).alias("feed"))).groupBy("file_id").agg(F.min("feed").alias("feed"))
    active = jobs.where(F.col("status").isin(ACTIVE)).select("file_id")
    return rows.join(active, "file_id", "left_anti").orderBy("feed", "file_id").limit(limit)
