"""Columns over texts and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: labels that stand for another.
CANONICAL_LABELS = {
    "insurance": ["appeal", "benefits", "claim", "explanation-of-benefits", "denial-letter", "appeal-template", "claim-form", "eligibility-notice"],
    "financial": ["medical-receipt", "reimbursement-packet", "fsa", "hsa", "receipt", "invoice", "statement", "bank", "billing-statement", "bank-statement", "check", "payment-history", "return-summary", "utility-bill", "hotel-folio"],
    "medical": ["pharmacy", "prescription", "otc-medication", "sunscreen", "spf-product", "cosmetic-spf", "medical-estimate"],
    "tax": ["tax-form"],
    "legal": ["contract", "policy"],
    "image-only": ["photo", "product-photo"],
    "identity-document": ["consumer-report"],
    "screenshot": ["ui-screenshot"],
}


def excerpt(text: Column, n: int = 280) -> Column:
    return F.substring(text, 1, n)


def without_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_name(name: Column) -> Column:
    """Letters and digits in lower case, all else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def folder_token(name: Column) -> Column:
    """A folder name as a singular slug."""
    slug = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug.rlike(".ies$"), F.regexp_replace(slug, "ies$", "y")).when(slug.rlike("..[^s]s$"), F.regexp_replace(slug, "s$", "")).otherwise(slug)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_segment(text: Column) -> Column:
    """A name fit for a path: no separators, no control characters, no outer blanks or dots."""
    return F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^[\s.]+|[\s.]+$", "")


def join_filled(*parts: Column) -> Column:
    """Parts that are not blank, trimmed and joined by single blanks."""
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def count_contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return F.aggregate(F.array(*map(F.lit, terms)), F.lit(0), lambda n, t: n + F.when(F.contains(text, t), 1).otherwise(0))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def extraction_quality(text: Column, *, high: int = 120, medium: int = 20, low: int = 8) -> Column:
    n = alnum_count(text)
    return F.when(n >= high, "high").when(n >= medium, "medium").when(n >= low, "low").otherwise("empty")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (inside lambdas, too)."""
    return F.transform(F.array(value), body)[0]


def distinct_ignoring_case(values: Column) -> Column:
    """Trimmed values that are not blank, the first of each in lower case, in order. Values are sorted, so that repeats are
    neighbours, and put back in order: time grows with n log n."""
    cleaned = F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    tagged = F.sort_array(F.transform(cleaned, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("v"))))

    def firsts(found: Column) -> Column:
        return F.filter(found, lambda x, j: F.coalesce(F.get(found, j - 1)["low"] != x["low"], F.lit(True)))

    placed = F.sort_array(F.transform(bound(tagged, firsts), lambda x: F.struct(x["at"].alias("at"), x["v"].alias("v"))))
    return F.transform(placed, lambda x: x["v"])


def canonical_label(label: Column) -> Column:
    cleaned = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    out = F.when(cleaned == "", "unknown")
    for name, labels in CANONICAL_LABELS.items():
        out = out.when(cleaned.isin(labels), name)
    return out.otherwise(cleaned)


def canonical_labels(labels: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), canonical_label))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def string_list(json: Column) -> Column:
    """A JSON array of strings, distinct ignoring case; anything else is empty."""
    return distinct_ignoring_case(F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>")))


def json_object(json: Column) -> Column:
    """A flat JSON object as a map of strings; anything else is empty."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def utc(text: Column) -> Column:
    """An ISO time with or without zone (``Z`` included); null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def age_seconds(then: Column, now: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0))


def sha_prefix(text: Column, n: int = 24) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))


def route_label(label: Column) -> Column:
    """A label as the router names it: lower case, blanks as hyphens; of other marks only ``. _ / -`` stay."""
    kept = F.regexp_replace(F.btrim(F.lower(F.coalesce(label, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), "[^a-z0-9._/ -]", " ")
    return F.btrim(F.regexp_replace(kept, r"\s+", "-"), F.lit("-"))


def category_label(label: Column) -> Column:
    """A label of the category list: what follows ``#`` is a comment, ``&`` means and; else as ``route_label``."""
    return route_label(F.replace(F.substring_index(F.coalesce(label, F.lit("")), "#", 1), F.lit("&"), F.lit(" and ")))


def alias_label(label: Column) -> Column:
    """A label of the external taxonomy: words of letters and digits with hyphens, ``&`` as and."""
    plain = F.regexp_replace(F.replace(F.lower(F.coalesce(label, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    return F.btrim(plain, F.lit("-"))
