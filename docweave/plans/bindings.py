"""The index's tables, bound to the driver's tables by fixed rules, as frames and as the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.readers import table

_EXT = "case doc_id % 7 when 1 then 'pdf' when 2 then 'csv' when 3 then 'png' else case when doc_id % 5 = 0 then 'md' else 'txt' end end"
_MIME = "case ext when 'pdf' then 'application/pdf' when 'csv' then 'text/csv' when 'png' then 'image/png' when 'md' then 'text/markdown' else 'text/plain' end"
_STAGING = "case when doc_id % 97 = 0 then '/_staging' else '' end"
_LABEL = "case when toxic = 1 then 'needs-review' when quality = 1 then 'report' else 'unknown' end"
_TERMS = "case when quality = 1 then '[\"the\",\"and\",\"license\"]' else '[\"de\",\"la\"]' end"
_STATUS = "case when toxic = 1 then 'failed' when doc_id % 3 = 0 then 'queued' else 'completed' end"
_JOB = "case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'completed' when 'signup' then 'failed' else 'cancelled' end"

_FILES = f"""
    select doc_id as id, concat('ext-', doc_id) as external_id, concat('Document ', doc_id, '.', ext) as name,
           concat('/', source, {_STAGING}, '/', lang, '/', 'Document ', doc_id, '.', ext) as path,
           {_MIME} as mime_type, ext as extension, n_chars as size_bytes, doc_id % 53 = 0 as is_deleted, {{modified}} as modified_at
    from (select *, {_EXT} as ext from documents) d
"""
_CONTENTS = "select doc_id as file_id, text as content_text, {sha} as content_hash from documents"
_STATES = f"""
    select doc_id as file_id, {_STATUS} as submission_status, {_LABEL} as primary_label, concat('summary of ', {_LABEL}) as summary,
           cast(0.3 + 0.6 * quality as double) as confidence, 'people: none' as entity_summary, concat('topic ', {_LABEL}) as topic_summary,
           {_TERMS} as retrieval_terms_json, concat('text ', doc_id) as retrieval_text from labels
"""
_JOBS = f"""
    select event_id as id, user_id as file_id, {_JOB} as status, ts as created_at, value as priority, event_type,
           event_id % 4 as priority_rank, case when event_id % 3 = 0 then null else ts end as next_attempt_at,
           case when event_id % 5 = 0 then null else ts end as heartbeat_at, props from events
"""

#: The same tables in DuckDB.
SQL = {
    "files": _FILES.format(modified="timestamp '2024-01-01' + to_hours(doc_id)"),
    "contents": _CONTENTS.format(sha="sha256(text)"),
    "states": _STATES,
    "jobs": _JOBS,
}


def with_tables(body: str, *names: str) -> str:
    """A DuckDB query over bound tables."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + "\n" + body


def _bound(spark: SparkSession, sf_dir: str, base: str, query: str) -> DataFrame:
    return spark.sql(query.replace(f"from {base}", "from {t}"), t=table(spark, sf_dir, base))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _FILES.format(modified="timestampadd(HOUR, doc_id, timestamp '2024-01-01')")
    return _bound(spark, sf_dir, "documents", query)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "documents", _CONTENTS.format(sha="sha2(text, 256)"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "labels", _STATES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "events", _JOBS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of pages: file of the same number, the page's html as text."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url"), F.col("html").alias("note_text"))
