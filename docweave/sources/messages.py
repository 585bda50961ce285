"""Landed mail messages: their nested parts and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_parts(messages: DataFrame, *, deepest: int = 100) -> DataFrame:
    """(id, path, depth, mime_type, data, turn) of every part of messages (id, payload: JSON with mimeType, body and parts), by a
    recursive common table expression over its nesting. ``path`` numbers children from 0; ``data`` is the decoded body; by
    ``turn`` a message's parts stand in the order of a walk that takes a part's last child first. Payloads that are null or no
    JSON objects have no parts. Parts deeper than ``deepest`` are an error."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many parts as there are
    walked = spark.sql(
        f"""
        with recursive walk(id, path, turn, depth, part) max recursion level {deepest} as (
            select id, '0', array(0), 0, payload from {{messages}} where get_json_object(payload, '$') like '{{{{%'
            union all
            select id, concat(path, '.', place), concat(turn, array(-place)), depth + 1, child
            from walk lateral view posexplode(from_json(get_json_object(part, '$.parts'), 'array<string>')) children as place, child
            where child like '{{{{%'
        ) select id, path, depth, part, turn from walk
        """,
        messages=messages.select("id", "payload"),
    )
    data = F.get_json_object("part", "$.body.data")
    body = F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8")
    return walked.select("id", "path", "depth", F.lower(F.trim(F.get_json_object("part", "$.mimeType"))).alias("mime_type"), body.alias("data"), "turn")


def message_text(parts: DataFrame, mime_type: str = "text/plain") -> DataFrame:
    """(id, text): the first part of a type in the order of the walk that has a text."""
    own = parts.where((F.col("mime_type") == mime_type) & (F.coalesce("data", F.lit("")) != ""))
    return own.groupBy("id").agg(F.min_by("data", "turn").alias("text"))
