"""Quality rules with DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated windows. The method's verdict compares two histograms
of a document, of character classes and of common words, with references of its language by Jensen-Shannon distance (square
root of the divergence, base 2). References are sums over all documents of a language, so they follow the corpus; there are
as many as languages in ``COMMON_WORDS`` and one for all others, which bounds what the driver collects. Short texts say
little about a distribution: below a minimum length a distance is not judged.

Most words are no common words, so even a text without any lies near its reference in that histogram. Hence ``STRICT``, which
op6 and the pipeline use, judges common words on the scale of that distance, which follows from the reference alone.

Defined results: a null or empty text has no words, fails the base rules and gets null distances; an unknown or null language
is compared with the nearest reference; repeated rows and ties give the same verdict; an empty table gives an empty result;
all other columns are carried along, and metrics whose names clash with them replace them in ``quality_rules`` only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACE_CHARS, SPACE_CLASS, shielded

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "fr": ["de", "la", "le", "les", "et", "des", "en", "que"],
    "de": ["der", "die", "und", "das", "den", "von", "ist", "nicht"],
    "es": ["el", "de", "la", "que", "y", "en", "los", "un"],
}
OTHER = "other"
#: Limits that junk can fail: good texts stay below 0.7 of the common words' scale, and symbol-stuffed ones lie at 0.29 or more in classes.
STRICT = {"max_class_distance": 0.28, "max_common_share": 0.8}
#: References this near to a text without common words hold too few of them to judge by.
_LEAST_SCALE = 0.15
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _word_list() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __t (text, null as empty) and __w (its words)."""
    trimmed = F.btrim(F.coalesce(text_col, F.lit("")), F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))
    return docs.select("*", F.coalesce(text_col, F.lit("")).alias("__t"), words.alias("__w"))


def histograms(df: DataFrame) -> DataFrame:
    """Adds __classes (capitals, digits, ASCII marks, white space, beyond ASCII, the rest) and __common (each common word,
    then all other words) to a frame with __t and __w."""
    words = _word_list()
    listed = F.array(*map(F.lit, words))
    df = df.select("*", F.transform(F.filter("__w", lambda w: w.isin(words)), lambda w: F.array_position(listed, w)).alias("__hits"))
    total = F.length("__t").cast("double")
    upper, digit, mark, beyond = (F.regexp_count("__t", F.lit(p)).cast("double") for p in (r"\p{Lu}", "[0-9]", r"[!-/:-@\[-`{-~]", r"[^\x00-\x7F]"))
    space = total - F.length(F.array_join("__w", "")).cast("double")
    df = df.select("*", F.array(upper, digit, mark, space, beyond).alias("__five"))
    rest = F.greatest(F.lit(0.0), total - F.aggregate("__five", F.lit(0.0), lambda a, x: a + x))
    
    def times(i: int) -> Column:
        return F.size(F.filter("__hits", lambda h: h == i)).cast("double")

    hit = [times(i) for i in range(1, len(words) + 1)]
    other = (F.size("__w") - F.size("__hits")).cast("double")
    return df.select("*", F.concat("__five", F.array(rest)).alias("__classes"), F.array(*hit, other).alias("__common")).drop("__hits", "__five")


def _language(lang_col: str) -> Column:
    known = F.lower(F.col(lang_col))
    return F.when(known.isin(list(COMMON_WORDS)), known).otherwise(F.lit(OTHER))


def language_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of all documents by language, as shares. One row a known language and one for the others reach the driver."""
    n_common = len(_word_list()) + 1
    counted = histograms(with_words(docs.select(F.col(text_col).alias("__text"), _language(lang_col).alias("__lang")), "__text"))
    sums = [F.sum(F.col("__classes")[i]).alias(f"a{i}") for i in range(6)] + [F.sum(F.col("__common")[i]).alias(f"b{i}") for i in range(n_common)]
    found = {}
    for row in counted.groupBy("__lang").agg(*sums).collect():
        parts = []
        for values in ([row[f"a{i}"] for i in range(6)], [row[f"b{i}"] for i in range(n_common)]):
            total = sum(values)
            parts.append([v / total for v in values] if total else None)
        if all(parts):
            found[row["__lang"]] = tuple(parts)
    return found


def shannon_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts and a reference of shares; null for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(counts, shares, lambda c, q: part(c / total, q) + part(q, c / total))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _against(counts: Column, lang: Column, refs: dict[str, tuple[list[float], list[float]]], k: int) -> Column:
    """Distance from the reference of the document's own language, or else from the nearest."""
    if not refs:
        return F.lit(None).cast("double")
    each = {name: shannon_distance(counts, F.array(*map(F.lit, ref[k]))) for name, ref in refs.items()}
    nearest = F.least(*each.values()) if len(each) > 1 else next(iter(each.values()))
    named = [(name, d) for name, d in each.items() if name != OTHER]
    if not named:
        return nearest
    chosen = reduce(lambda w, nd: w.when(lang == nd[0], nd[1]), named[1:], F.when(lang == named[0][0], named[0][1]))
    return chosen.otherwise(nearest)


def _without_common_words(shares: list[float]) -> float:
    """Distance of a text without a single common word from a reference; only the last bin of both is filled."""
    q = shares[-1]
    return math.sqrt(max(0.0, (math.log2(2 / (1 + q)) + (q * math.log2(2 * q / (1 + q)) if q else 0.0) + 1 - q) / 2))


def _common_limit(lang: Column, refs: dict[str, tuple[list[float], list[float]]], share: float) -> Column:
    """``share`` of the distance of a text without common words: of the own language, or the least of all for other languages."""
    scales = {name: _without_common_words(ref[1]) for name, ref in refs.items() if name != OTHER}
    limits = {name: share * scale for name, scale in scales.items() if scale >= _LEAST_SCALE}
    none = F.lit(None).cast("double")
    if not limits:
        return none
    known = reduce(lambda w, nl: w.when(lang == nl[0], nl[1]), list(limits.items())[1:], F.when(lang == next(iter(limits)), next(iter(limits.values()))))
    few = [name for name in scales if name not in limits]
    return F.when(lang.isin(few), none).otherwise(known.otherwise(min(limits.values()))) if few else known.otherwise(min(limits.values()))


def base_metrics(df: DataFrame) -> DataFrame:
    """Adds the base counts to a frame with __t and __w.

    A window is three successive words. Windows are hashed to 64 bits; hash prefixes and positions are packed into one long
    each, sorted, and neighbours with equal hashes are repeats. All of it stays inside the row.
    """
    n = F.size("__w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    df = df.select("*", hashes.alias("__h"), lines.alias("__lines"))
    bits = F.when(n < 1 << 20, 20).when(n < 1 << 24, 24).otherwise(31)
    df = df.select("*", bits.alias("__bits"), (F.size("__h") > F.size(F.array_distinct("__h"))).alias("__any"))
    low = F.expr("shiftleft(1L, __bits) - 1")
    packed = F.when(F.col("__any"), F.sort_array(F.transform("__h", lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", low.alias("__low"), packed.alias("__sorted"))

    def same(a: Column, b: Column) -> Column:
        low = F.col("__low")
        alike = a.bitwiseXOR(b) <= low  # equal prefixes; the exclusive or is not negative then
        return alike & (a.bitwiseXOR(b) >= 0) & (F.get("__h", a.bitwiseAND(low).cast("int")) == F.get("__h", b.bitwiseAND(low).cast("int")))

    before = F.concat(F.array(F.lit(None).cast("bigint")), F.col("__sorted"))
    pairs = F.transform("__sorted", lambda x, i: F.when(F.coalesce(same(x, F.get("__before", i)), F.lit(False)), F.array(F.get("__before", i), x)))
    df = df.select("*", before.alias("__before"))
    repeated = F.sort_array(F.array_distinct(F.transform(F.flatten(F.filter(pairs, lambda p: p.isNotNull())), lambda x: x.bitwiseAND(F.col("__low")))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    covered = F.aggregate(repeated, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return df.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__any"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


@shielded(text_col="text", lang_col="lang")
def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    references: dict[str, tuple[list[float], list[float]]] | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_chars_classes: int = 400,
    max_class_distance: float = 0.5,
    min_words_common: int = 150,
    max_common_distance: float = 0.62,
    max_common_share: float | None = None,
) -> DataFrame:
    """All columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    common_distance (null below the minimum lengths) and kept. References are fitted on ``docs`` unless given."""
    refs = language_references(docs, text_col=text_col, lang_col=lang_col) if references is None else references
    own = {m.lower() for m in (*METRICS, "base_failed", "class_distance", "common_distance", "kept")} - {text_col.lower(), lang_col.lower()}
    columns = [c for c in docs.columns if c.lower() not in own]
    df = histograms(base_metrics(with_words(docs.select(*columns), text_col)))
    lang = _language(lang_col)
    df = df.select(
        "*",
        F.when(F.length("__t") >= min_chars_classes, _against(F.col("__classes"), lang, refs, 0)).alias("class_distance"),
        F.when(F.col("n_words") >= min_words_common, _against(F.col("__common"), lang, refs, 1)).alias("common_distance"),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("common_distance", F.lit(0.0)) > max_common_distance)
    if max_common_share is not None:
        diverges = diverges | F.coalesce(F.col("common_distance") > _common_limit(lang, refs, max_common_share), F.lit(False))
    # not deterministic in name only: keeps filters on these columns from being pushed down, which would copy whole expressions into them
    held = F.monotonically_increasing_id() >= 0
    verdict = (~F.col("base_failed") & ~diverges).alias("kept")
    own_columns = [F.when(held, F.col(c)).alias(c) for c in (*METRICS, "base_failed", "class_distance", "common_distance")]
    return df.select(*columns, *own_columns, F.when(held, verdict).alias("kept"))


def good_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **options: object) -> DataFrame:
    """``docs`` without rows that the rules reject; columns whose names clash with the rules' own keep their values."""
    names = {c: f"__q{i}" for i, c in enumerate(docs.columns)}
    judged = quality_rules(docs.toDF(*names.values()), text_col=names[text_col], lang_col=names[lang_col], **options)
    return judged.where("kept").select(*(F.col(q).alias(c) for c, q in names.items()))
