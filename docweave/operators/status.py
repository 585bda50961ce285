"""Status reports, notes of files, refresh control and job updates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text

#: MIME types by extension, and that of any other.
CONTENT_TYPES = {
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "html": "text/html",
    "css": "text/css",
    "json": "application/json",
    "xml": "text/xml",
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "zip": "application/zip",
}
DEFAULT_TYPE = "application/octet-stream"
#: Labels of images in order of preference, and words of file names that allow two more.
IMAGE_LABELS = [
    "reference-image", "concept-art", "environment-art", "game-reference",
    "architecture", "industrial", "sci-fi", "snow-ice", "frozen-environment",
    "post-apocalyptic", "waystation", "facility", "building", "interior",
    "exterior", "machinery", "landscape", "artwork", "photo", "image-only",
    "unknown", "needs-review",
]
IMAGE_EXCEPTIONS = {
    "technical": ["screenshot", "screen", "ui", "terminal", "error", "diagram", "schematic", "code"],
    "marketing": ["product", "ad", "promo", "marketing", "catalog", "store", "package"],
}


def folder_counts(files: DataFrame, roots: list[str]) -> DataFrame:
    """(root, n): files at any depth below each root folder, 0 where there are none. One scan serves all roots."""
    inside = F.array_compact(F.array(*(F.when(F.col("path").startswith(f"/{r.strip('/')}/"), F.lit(r)) for r in roots)))
    found = files.select(F.explode(inside).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    named = files.sparkSession.createDataFrame([(r,) for r in roots], "root string")
    return named.join(found, "root", "left").select("root", F.coalesce("n", F.lit(0)).alias("n"))


def reason_counts(rows: DataFrame, reasons: Column) -> DataFrame:
    """(reason, n, n_first): how many rows have each reason, and for how many it is the first."""
    each = rows.select(F.posexplode(reasons).alias("at", "reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 0).alias("n_first"))


def summary(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(section, key, n): counts of a key in each section's frame, one report. A section of one number has a literal key."""
    each = [df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "key", "n") for name, (df, key) in parts.items()]
    return reduce(DataFrame.unionByName, each)


def ends_with(path: Column, name: Column) -> Column:
    """Whether a path ends with a name, ignoring case; ``%`` and ``_`` of the name match as in LIKE."""
    return F.like(F.lower(path), F.concat(F.lit("%"), F.lower(name)))


def is_subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def first_distinct(rows: DataFrame, value: str, order: str, most: int = 50) -> DataFrame:
    """Distinct values in the order of their first row, at most ``most``."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value).limit(most)


def content_type(name: Column) -> Column:
    """MIME type by a file name's extension."""
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit(DEFAULT_TYPE))


def hash_noise(name: Column) -> Column:
    """Whether a note's name carries a hash at its end or start."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return stem.rlike(r" - [0-9a-f]{8,}$") | stem.rlike(r"^[0-9a-f]{16,}-")


def suffix_rank(name: Column) -> Column:
    """0 for a plain note name, else the number in `` (n).md``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r" \((\d+)\)\.md$", 1), F.lit("")).cast("long"), F.lit(0))


def image_labels(categories: Column, name: Column) -> Column:
    """Categories that suit an image: technical and marketing ones only where the name allows them, preferred ones first."""
    low = F.lower(F.coalesce(name, F.lit("")))
    gone = F.array_compact(F.array(*(F.when(~reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(label)) for label, words in IMAGE_EXCEPTIONS.items())))
    kept = F.filter(categories, lambda c: ~F.array_contains(gone, c))
    return text.bound(kept, lambda k: F.array_distinct(F.concat(F.array_intersect(F.array(*map(F.lit, IMAGE_LABELS)), k), k)))


def note_details(files: DataFrame, states: DataFrame, notes: DataFrame, *, most: int = 10_000, excerpt: int = 280) -> DataFrame:
    """One row a live file with its note, if any: (file_id, note_text, metadata) of ``notes``. The source's path comes from the
    note's metadata, or else the file's own; a link from the metadata, or else built from that path."""
    found = files.join(states.select(F.col("file_id").alias("id"), "primary_label"), "id", "left").join(notes.withColumnRenamed("file_id", "id"), "id", "left")
    note = F.coalesce("note_text", F.lit(""))
    known = lambda key: F.nullif(F.trim(F.try_element_at("metadata", F.lit(key))), F.lit(""))
    source = F.coalesce(known("canonical_source_path"), F.col("path"))
    return found.select(
        "id",
        "name",
        "path",
        "primary_label",
        F.col("note_text").isNotNull().alias("note_available"),
        F.substring(note, 1, most).alias("note_content"),
        F.length(note).cast("long").alias("note_length"),
        (F.length(note) > most).alias("note_truncated"),
        text.excerpt(note, excerpt).alias("note_excerpt"),
        source.alias("canonical_source_path"),
        F.coalesce(known("source_link"), source_link(source, F.col("name"))).alias("source_link"),
        known("attachment_mode").alias("attachment_mode"),
    )


def source_link(path: Column, name: Column) -> Column:
    """A Markdown link to a source; blanks and brackets of its path are escaped."""
    escaped = F.replace(F.replace(F.replace(path, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.concat(F.lit("["), name, F.lit("](file://"), escaped, F.lit(")"))


def canonical_source_link(path: Column, name: Column, *, root: str, base: str) -> Column:
    """A Markdown link to a source in angle brackets; null and blank paths give none (an empty text). What lies below ``root`` is
    linked below ``base``: a share or a drive with backslashes, anything else as a URL. Other paths are linked as files."""
    source = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    below, base = F.lit(len(root) + 1), base.strip()
    rest = F.substring(source, below, F.length(source))
    windows = base.startswith("\\\\") or re.match(r"[A-Za-z]:[/\\]", base) is not None
    target = F.concat(F.lit(base.rstrip("\\/") + "\\"), F.replace(rest, F.lit("/"), F.lit("\\"))) if windows else F.concat(F.lit(base.rstrip("/") + "/"), rest)
    target = F.when(source.startswith(root), target).when(source.rlike("^[A-Za-z]:/"), F.concat(F.lit("file:///"), source)).otherwise(F.concat(F.lit("file://"), source))
    link = F.concat(F.lit("["), F.replace(F.coalesce(name, F.lit("")), F.lit("]"), F.lit("\\]")), F.lit("](<"), target, F.lit(">)"))
    return F.when(F.coalesce(source, F.lit("")) == "", F.lit("")).otherwise(link)


def swap_leases(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after compare-and-swap updates (id, expected, next_status, next_payload): one applies only to a running job whose
    payload is the expected one. Of several for a job the smallest next payload counts. Adds swapped."""
    own = updates.groupBy("id", "expected").agg(F.min(F.struct("next_payload", "next_status")).alias("u"))
    both = jobs.alias("j").join(own.alias("o"), (F.col("j.id") == F.col("o.id")) & F.col("j.payload").eqNullSafe(F.col("o.expected")) & (F.col("j.status") == "running"), "left")
    hit = F.col("u").isNotNull()
    return both.select("j.id", F.when(hit, F.col("u.next_status")).otherwise(F.col("j.status")).alias("status"), F.when(hit, F.col("u.next_payload")).otherwise(F.col("j.payload")).alias("payload"), hit.alias("swapped"))


def deferred(jobs: DataFrame, path: Column, prefix: str, now: Column, *, hours: int = 2, mark: str = "deferred") -> DataFrame:
    """Queued jobs of paths under a prefix are put off; others stay as they are."""
    hit = (F.col("status") == "queued") & path.startswith(prefix)
    return jobs.withColumns({"next_attempt_at": F.when(hit, now + F.make_dt_interval(hours=F.lit(hours))).otherwise(F.col("next_attempt_at")), "error": F.when(hit, F.lit(mark))})


def refresh_due(runs: DataFrame, active: DataFrame, now: Column, *, every_seconds: int = 1800, paused: bool = False) -> DataFrame:
    """One row: whether a background refresh is to be queued, from completed runs (completed_at) and active jobs."""
    done = runs.select("completed_at", F.lit(False).alias("busy"))
    both = done.unionByName(active.select(F.lit(None).cast("timestamp").alias("completed_at"), F.lit(True).alias("busy")))
    row = both.agg(F.max("completed_at").alias("last_completed_at"), F.coalesce(F.max("busy"), F.lit(False)).alias("busy"))
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_completed_at")
    due = F.lit(not paused and every_seconds > 0) & ~F.col("busy") & F.coalesce(waited >= every_seconds, F.lit(True))
    return row.select("last_completed_at", "busy", due.alias("due"))


def upsert_notes(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """Index rows (path, hash) after a scan: path, hash and change (inserted, updated, unchanged or missing)."""
    both = index.select("path", F.col("hash").alias("old")).join(scanned.select("path", F.col("hash").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return both.select("path", F.coalesce("new", "old").alias("hash"), change.alias("change"))
