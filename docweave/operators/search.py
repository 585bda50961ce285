"""Ranked keyword search over the index, with path scopes and explainable reasons."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths, text

#: Points for the whole query and for each token, by field, and for a retrieval term.
WEIGHTS = {
    "name": (180, 25),
    "path": (120, 18),
    "primary_label": (220, 60),
    "summary": (90, 18),
    "entity_summary": (150, 30),
    "topic_summary": (135, 28),
    "retrieval_text": (110, 20),
    "content_text": (70, 14),
}
TERM_POINTS = 24
#: Fixed value: reasons in order, by field.
REASONS = {"name": "name", "path": "path", "primary_label": "label", "summary": "summary", "entity_summary": "entities", "topic_summary": "topics", "content_text": "content"}
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._:/#-]{1,63}"


def tokens(query: str) -> list[str]:
    """The query's distinct tokens in lower case, in order."""
    return list(dict.fromkeys(t.lower() for t in re.findall(TOKEN, query)))


def _low(field: str) -> Column:
    return F.lower(F.coalesce(F.col(field), F.lit("")))


def index_rows(files: DataFrame, contents: DataFrame, states: DataFrame) -> DataFrame:
    """Files with their text and state where they have them. Ids are unique on the right, so the joins keep one row a file."""
    return files.join(contents.withColumnRenamed("file_id", "id"), "id", "left").join(states.withColumnRenamed("file_id", "id"), "id", "left")


def matches(query: str, fields: list[str] | None = None) -> Column:
    q = query.strip().lower()
    return reduce(lambda a, b: a | b, (F.contains(_low(f), F.lit(q)) for f in fields or [*WEIGHTS, "retrieval_terms_json"]))


def score(query: str) -> Column:
    q, parts = query.strip().lower(), tokens(query)
    total = F.lit(0)
    for field, (full, each) in WEIGHTS.items():
        low = _low(field)
        total = total + F.when(F.contains(low, F.lit(q)), full).otherwise(0)
        for t in parts:
            total = total + F.when(F.contains(low, F.lit(t)), each).otherwise(0)
    wanted = [q, *parts]
    hit = F.filter(text.string_list(F.col("retrieval_terms_json")), lambda term: reduce(lambda a, b: a | b, (F.contains(F.lower(term), F.lit(w)) for w in wanted)))
    return (total + TERM_POINTS * F.size(hit)).cast("long")


def reasons(query: str, most: int = 4) -> Column:
    wanted = [query.strip().lower(), *tokens(query)]
    named = [F.when(reduce(lambda a, b: a | b, (F.contains(_low(f), F.lit(w)) for w in wanted)), F.lit(r)) for f, r in REASONS.items()]
    return F.slice(F.array_compact(F.array(*named)), 1, most)


def search(files: DataFrame, contents: DataFrame, states: DataFrame, query: str, *, limit: int = 10, path_scope: str | None = None) -> DataFrame:
    """The best ``limit`` files. The first ``max(8 limit, 40)`` matches by id are candidates; hidden paths go after that cut."""
    rows = index_rows(files.where(~F.col("is_deleted") & paths.in_scope(F.col("path"), path_scope)), contents, states)
    if not query.strip():
        rows = rows.limit(0)
    first = rows.where(matches(query)).orderBy("id").limit(max(8 * limit, 40))
    shown = first.where(~paths.has_hidden_segment(F.col("path")))
    ranked = shown.select("id", "name", "path", "mime_type", "primary_label", "confidence", score(query).alias("score"), reasons(query).alias("match_reasons"), text.excerpt(F.coalesce("content_text", F.lit(""))).alias("excerpt"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def file_details(files: DataFrame, contents: DataFrame, ids: list[int], *, most: int = 10_000) -> DataFrame:
    """Texts cut at ``most`` characters, their true length and whether they were cut; hidden and deleted files are left out."""
    rows = files.where(F.col("id").isin(ids) & ~F.col("is_deleted") & ~paths.has_hidden_segment(F.col("path"))).join(contents.withColumnRenamed("file_id", "id"), "id", "left")
    body = F.coalesce("content_text", F.lit(""))
    return rows.select("id", "name", "path", F.substring(body, 1, most).alias("content_text"), F.length(body).cast("long").alias("content_chars"), (F.length(body) > most).alias("truncated"))


def search_bundles(files: DataFrame, contents: DataFrame, states: DataFrame, notes: DataFrame, query: str, *, limit: int = 10, hydrate: int = 3, path_scope: str | None = None, note_chars: int = 50_000) -> DataFrame:
    """The best ``hydrate`` results with their note; results without one are left out."""
    top = search(files, contents, states, query, limit=limit, path_scope=path_scope).orderBy(F.desc("score"), "id").limit(hydrate)
    cut = notes.select(F.col("file_id").alias("id"), F.substring("note_text", 1, note_chars).alias("note_text"))
    return top.select("id", "path", "score").join(cut, "id")


def within_namespace(results: DataFrame, namespace: str) -> DataFrame:
    """Results of one namespace, filtered after the ranked cut."""
    return results.where(F.col("path").startswith(f"/{namespace}/"))
