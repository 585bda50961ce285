"""Readers and writers of the formats the index is fed from."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Fixed value: folders a crawl leaves out.
EXCLUDED = [".git", ".venv", "__pycache__", "build", "dist", "node_modules", "venv"]
TEXT_EXTENSIONS = ["txt", "md", "markdown", "csv", "tsv", "json", "xml", "html", "htm", "css", "log", "yaml", "yml", "ini"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(files: DataFrame, contents: DataFrame, *, most_chars: int = 1200) -> DataFrame:
    """Live files with the beginning of their text."""
    rows = files.where(~F.col("is_deleted")).join(contents.withColumnRenamed("file_id", "id"), "id", "left")
    return rows.select("id", "name", "path", F.coalesce("extension", F.lit("")).alias("extension"), F.substring(F.coalesce("content_text", F.lit("")), 1, most_chars).alias("content_text"))


def candidates_by_patterns(files: DataFrame, contents: DataFrame, words: list[str], extensions: list[str], quota: int) -> DataFrame:
    """Files with one of the words in name, path or text, or one of the extensions; at most ``max(25 quota, 80)`` by id."""
    rows = files.join(contents.withColumnRenamed("file_id", "id"), "id", "left")
    hit = F.lit(False)
    for c in ("name", "path", "content_text"):
        lowered = F.lower(F.coalesce(F.col(c), F.lit("")))
        for w in words:
            hit = hit | F.contains(lowered, F.lit(w))
    return rows.where(hit | F.col("extension").isin(extensions)).orderBy("id").limit(max(25 * quota, 80)).select("id", "path", "extension")


def crawl(spark: SparkSession, root: str, *, most_bytes: int = 1_048_576, excluded: list[str] | None = None) -> DataFrame:
    """Every file under a folder: path, name, extension, size, time, and its bytes up to ``most_bytes``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    gone = "|".join(re.escape(e) for e in excluded or EXCLUDED)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(~F.col("path").rlike(f"/({gone})/")).select("path", name.alias("name"), F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def normalize_item(raw: DataFrame) -> DataFrame:
    """Raw items of any of four spellings of the MIME type, with a default."""
    mime = F.coalesce(*(F.col(c) for c in ("mime_type", "mimeType", "contentType", "content_type") if c in raw.columns), F.lit("application/octet-stream"))
    return raw.select(F.col("id").cast("string").alias("external_id"), "name", "path", F.lower("extension").alias("extension"), mime.alias("mime_type"), F.col("size").cast("long").alias("size_bytes"), F.col("modified").cast("timestamp").alias("modified_at"))


def json_lines(spark: SparkSession, path: str, schema: str, last: int | None = None) -> DataFrame:
    """Rows of JSON lines with their file and place (block, at: rising within a file); bad lines are dropped. Files are read by
    line and may be split. ``last`` keeps that many lines of each file before any is parsed."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(where.alias("m"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    lines = lines.select("m.file", "m.block", "at", "line")
    if last is not None:
        back = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"), F.desc("at")))
        lines = lines.withColumn("back", back).where(F.col("back") <= last).drop("back")
    parsed = lines.select("file", "block", "at", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("line").alias("any"))
    return parsed.where("any is not null and row is not null").select("file", "block", "at", "row.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; where some are bad, those are left out."""
    whole = content.cast("string")
    return F.when(F.is_valid_utf8(whole), whole).otherwise(F.replace(F.decode(content, "UTF-8"), F.lit("�"), F.lit("")))


def frontmatter(text: Column) -> Column:
    """The ``key: value`` lines between leading ``---`` lines as a map; quotes around values go."""
    head = F.regexp_extract(text, r"^---\r?\n((?s:.*?))\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z0-9_]+\s*:"))
    entries = F.transform(lines, lambda line: F.struct(F.trim(F.regexp_extract(line, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)), '^"|"$', "").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1))


def note_body(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def notes(spark: SparkSession, root: str, *, skip: list[str] | None = None) -> DataFrame:
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    for prefix in skip or []:
        rows = rows.where(~F.contains("path", F.lit(prefix)))
    return rows.select("path", frontmatter(F.col("text")).alias("metadata"), note_body(F.col("text")).alias("body"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in tree.iter(f"{_W}p"))
    return "\n".join(t for t in texts if t.strip())


def _sheets(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")] if "xl/workbook.xml" in names else []
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for i, n in enumerate(files):
            rows = []
            for row in ElementTree.fromstring(z.read(n)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else ""))
                rows.append(cells)
            out.append((titles[i] if i < len(titles) else n, rows))
    return out


def _xlsx(raw: bytes) -> str:
    return "\n".join(c for _, rows in _sheets(raw) for row in rows for c in row if c)


def _preview(raw: bytes) -> str:
    """Up to 4 sheets of 8 rows of 8 cells of 80 characters, as Markdown tables."""
    parts = []
    for title, rows in [s for s in _sheets(raw) if "metadata" not in s[0].lower()][:4]:
        table = [[c[:80] for c in row[:8]] for row in rows[:8]]
        parts.append(f"## {title}\n" + "\n".join("| " + " | ".join(r) + " |" for r in table))
    return "\n\n".join(parts)


def _safely(f: object) -> object:
    def run(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in contents:
            out = []
            for raw in series:
                try:
                    out.append("" if raw is None else f(bytes(raw)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    out.append("")
            yield pd.Series(out, dtype="string")

    run.__annotations__ = {"contents": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


docx_text, xlsx_text, sheet_preview = _safely(_docx), _safely(_xlsx), _safely(_preview)


def extracted(files: DataFrame) -> DataFrame:
    """Text of crawled files by extension; kinds without a reader give an empty text, and a parser name says which was used."""
    ext = F.col("extension")
    kind = F.when(ext.isin(TEXT_EXTENSIONS), "text").when(ext == "docx", "docx").when(ext == "xlsx", "xlsx").otherwise("none")
    rows = files.withColumn("parser", kind)
    plain = rows.where("parser = 'text'").withColumn("text", decoded(F.col("content")))
    docx = rows.where("parser = 'docx'").withColumn("text", docx_text("content"))
    xlsx = rows.where("parser = 'xlsx'").withColumn("text", xlsx_text("content"))
    none = rows.where("parser = 'none'").withColumn("text", F.lit(""))
    return plain.union(docx).union(xlsx).union(none).select("path", "parser", F.translate(F.coalesce("text", F.lit("")), "\0", "").alias("text"))


def choose_text(native: Column, scanned: Column, least: int = 80) -> Column:
    """Native text, unless it has under ``least`` letters and digits and the scanned one is longer."""
    n = F.length(F.regexp_replace(F.coalesce(native, F.lit("")), r"[^\p{L}\p{N}]", ""))
    return F.when((n < least) & (F.length(F.coalesce(scanned, F.lit(""))) > F.length(F.coalesce(native, F.lit("")))), scanned).otherwise(native)


def _first_object(text: str | None) -> str | None:
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object in a text."""
    return texts.map(_first_object)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, white space is squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_month(messages: DataFrame, path: str, when: str) -> None:
    """Messages as JSON under year and month folders."""
    messages.withColumns({"year": F.date_format(when, "yyyy"), "month": F.date_format(when, "MM")}).write.mode("overwrite").partitionBy("year", "month").json(path)
