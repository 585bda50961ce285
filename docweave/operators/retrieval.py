"""Retrieval metadata: entities, topics, terms and the text they are found by."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions import paths, text

TOKEN = r"[A-Za-z0-9][A-Za-z0-9._:/#-]{1,63}"
#: Words that are no terms.
STOP_WORDS = ["and", "for", "from", "that", "this", "with", "your", "have", "will", "file", "document", "folder", "shared", "untitled", "draft", "copy", "final", "updated", "notes"]
#: Words that tell a topic.
TOPICS = {
    "medical": ["patient", "provider", "clinic", "hospital", "diagnosis", "prescription", "vyepti"],
    "insurance": ["insurance", "claim", "coverage", "benefits", "eob", "deductible", "copay"],
    "legal": ["agreement", "contract", "terms", "notice", "policy", "appeal", "dispute"],
    "tax": ["tax", "1099", "w-2", "w2", "irs", "refund", "withholding"],
    "financial": ["invoice", "receipt", "statement", "payment", "budget", "balance", "bank", "venmo"],
    "travel": ["hotel", "flight", "airline", "reservation", "itinerary", "uber"],
    "identity": ["driver license", "passport", "ssn", "social security", "id card", "name change"],
    "education": ["school", "course", "student", "philosophy", "essay", "assignment"],
    "technical": ["incident", "server", "network", "log", "source code", "configuration", "manual"],
    "shopping": ["order", "return", "purchase", "shipping", "merchant", "lowe", "amazon"],
    "screenshot": ["screenshot", "screen shot", "ui", "dialog", "error", "window"],
    "photo": ["photo", "image", "jpeg", "camera", "portrait", "family"],
}
#: Patterns of entities.
DATE = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s+\d{4})\b"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]*)?(?:\(?\d{3}\)?[-.\s]*)\d{3}[-.\s]*\d{4}\b"
LABELED = (
    r"(?im)\b(patient(?:\s+name)?|member(?:\s+name)?|subscriber(?:\s+name)?|provider|doctor|physician|clinic|hospital|insurer|insurance company|vendor|merchant|"
    r"bank(?:/issuer name)?|issuer|hotel|airline|employer|employee|customer|company|organization)\s*[:#-]\s*([^\n|]{2,100})"
)
IDENTIFIER = (
    r"(?im)\b(claim(?:\s+id|\s+#)?|member\s+id|policy(?:\s+number)?|account(?:\s+number)?|invoice(?:\s+number)?|order(?:\s+number)?|case(?:\s+number)?|reference(?:\s+number)?|"
    r"tracking(?:\s+number)?|confirmation(?:\s+number)?|authorization(?:\s+number)?|rx(?:\s+number)?|appeal(?:\s+id)?|check(?:\s+number|\s+no)?|folio(?:\s+no)?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{2,40})"
)
PEOPLE = "patient|member|subscriber|employee|customer"
GROUPS = ("people", "organizations", "identifiers", "dates", "emails", "phones")


def _all(body: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))


def entity_groups(body: Column, most: int = 5) -> Column:
    """Struct of the six groups, each distinct ignoring case and cut at ``most``. A text is searched once for each pattern: the parts
    of a match are taken from the match alone (nothing in the patterns looks behind or ahead but the boundary before it), and a
    bound struct is not taken apart into searches for each use of a group."""

    def parts(pattern: str, one: Callable[[Column, Column], Column]) -> Column:
        return F.transform(_all(body, pattern), lambda m: one(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))

    def named(pairs: Column) -> Column:
        people = F.transform(F.filter(pairs, lambda p: p["label"].rlike(PEOPLE)), lambda p: p["value"])
        others = F.transform(F.filter(pairs, lambda p: ~p["label"].rlike(PEOPLE)), lambda p: p["value"])
        found = [people, others, identifiers, _all(body, DATE), _all(body, EMAIL), _all(body, PHONE)]
        return F.struct(*(F.slice(text.distinct_ignoring_case(v), 1, most).alias(g) for g, v in zip(GROUPS, found, strict=True)))

    pairs = parts(LABELED, lambda a, b: F.struct(F.lower(a).alias("label"), F.trim(F.regexp_replace(F.btrim(b, F.lit(" \t\r\n,.;")), r"\s+", " ")).alias("value")))
    identifiers = parts(IDENTIFIER, lambda a, b: F.concat(F.trim(a), F.lit(": "), F.trim(b)))
    return text.bound(pairs, named)


def _useful(values: Column) -> Column:
    return F.filter(values, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def path_terms(path: Column) -> Column:
    """Words of the file's stem, then of all path parts."""
    parts = F.concat_ws(" ", paths.stem(paths.base_name(path)), F.replace(path, F.lit("/"), F.lit(" ")))
    return F.array_distinct(_useful(F.split(F.lower(parts), "[^a-z0-9]+")))


def entity_terms(groups: Column) -> Column:
    values = F.flatten(F.array(*(groups[g] for g in GROUPS)))
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.concat(F.array(F.lower(v)), _useful(F.split(F.lower(v), "[^a-z0-9]+"))))))


def topics(lookup: Column, labels: Column) -> Column:
    """Topics whose words the text holds or that are labels themselves, then all labels."""
    lowered = F.transform(labels, F.lower)

    def named(held: Column) -> Column:
        hits = ((t, reduce(or_, (F.contains(held, F.lit(w)) for w in words), F.array_contains(lowered, F.lit(t)))) for t, words in TOPICS.items())
        return F.array_compact(F.array(*(F.when(hit, F.lit(t)) for t, hit in hits)))

    return text.distinct_ignoring_case(F.concat(text.bound(lookup, named), lowered))


def text_terms(docs: DataFrame, *, id_col: str, text_col: str, most: int = 24) -> DataFrame:
    """(id, term, n, place): the commonest tokens of each text. Tokens are counted before the shuffle by id and token."""
    cleaned = F.transform(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit("._/-")))
    counted = docs.select(id_col, F.explode(_useful(cleaned)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "term"))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def top_terms(body: Column, most: int = 24) -> Column:
    """The commonest tokens of a text as a column: tokens are sorted and their runs counted inside the row."""
    cleaned = _useful(F.transform(F.regexp_extract_all(F.lower(body), F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit("._/-"))))

    def ranked(kept: Column, start: Column) -> Column:
        runs = F.transform(start, lambda i, j: F.struct((i - F.coalesce(F.get(start, j + 1), F.size(kept))).alias("minus_n"), F.get(kept, i).alias("term")))
        return F.transform(F.slice(F.sort_array(runs), 1, most), lambda r: r["term"])

    def counted(kept: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(kept)), lambda i: (i < F.size(kept)) & F.coalesce(F.get(kept, i - 1) != F.get(kept, i), F.lit(True)))
        return text.bound(starts, lambda start: ranked(kept, start))

    return text.bound(F.sort_array(cleaned), counted)  # array_sort compares by an interpreted function


def retrieval_metadata(docs: DataFrame, *, id_col: str = "id", path_col: str = "path", text_col: str = "content_text", labels_col: str = "labels", most_chars: int = 20_000, most_terms: int = 24) -> DataFrame:
    """entity_summary, topic_summary, retrieval_terms and retrieval_text of each file."""
    body = F.substring(F.coalesce(text_col, F.lit("")), 1, most_chars)
    df = docs.select(F.col(id_col), F.col(path_col).alias("path"), body.alias("body"), text.distinct_ignoring_case(F.coalesce(labels_col, F.array().cast("array<string>"))).alias("labels"))
    df = df.withColumns({"groups": entity_groups(F.col("body")), "path_terms": path_terms(F.col("path"))})
    lookup = F.concat_ws(" ", F.lower("body"), F.array_join("path_terms", " "), F.lower(F.array_join("labels", " ")))
    df = df.withColumn("lookup", lookup)
    df = df.withColumn("topics", topics(F.col("lookup"), F.col("labels")))
    words = top_terms(F.concat(paths.base_name(F.col("path")), F.lit("\n"), F.col("body")))
    df = df.withColumn("words", words)
    terms = F.slice(text.distinct_ignoring_case(F.concat("topics", "labels", "path_terms", entity_terms(F.col("groups")), "words")), 1, most_terms)
    sections = [F.when(F.size(F.col("groups")[g]) > 0, F.concat(F.lit(f"{g}: "), F.array_join(F.col("groups")[g], ", "))) for g in GROUPS]
    df = df.withColumns({"retrieval_terms": terms, "entity_summary": F.concat_ws("; ", *sections), "topic_summary": F.array_join(F.slice("topics", 1, 12), ", ")})
    parts = [paths.base_name(F.col("path")), F.col("path"), F.array_join("labels", " "), F.col("topic_summary"), F.col("entity_summary"), F.array_join("retrieval_terms", " "), F.substring("body", 1, 4000)]
    whole = F.trim(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))
    return df.select(id_col, "entity_summary", "topic_summary", "retrieval_terms", whole.alias("retrieval_text"))
