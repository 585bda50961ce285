"""Rule labels, gating and review decisions, as columns over rules given as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text

#: Extensions and types by kind.
SPREADSHEETS = ["csv", "xls", "xlsx"]
WEB_TEXTS = ["html", "htm", "txt", "md", "markdown"]
DOCUMENTS = ["pdf", "doc", "docx", "txt", "md", "markdown", "csv", "html", "htm", "xls", "xlsx", "ppt", "pptx"]
IMAGES = ["jpg", "jpeg", "png", "heic", "webp", "gif", "bmp", "tif", "tiff", "jxr"]
ARCHIVES = ["7z", "bz2", "cab", "dmg", "gz", "iso", "rar", "tar", "tgz", "xz", "zip"]
ARCHIVE_TYPES = ["gzip", "vnd.rar", "x-7z-compressed", "x-bzip2", "x-compressed", "x-compress", "x-tar", "x-xz", "zip"]
CODE = ["ts", "tsx", "js", "jsx", "py", "go", "java", "c", "cc", "cpp", "cs", "rs", "sh"]
#: Thresholds of the fast path.
GATING = {"heuristic_fast_confidence": 0.92, "model_fast_confidence": 0.8, "aligned_soft_confidence": 0.6, "needs_llm_threshold": 0.45, "disagreement_risk_threshold": 0.35, "teacher_confidence_threshold": 0.85}
REVIEW_CONFIDENCE = 0.70

Rules = dict[str, list[str]]


def is_image(ext: Column, mime: Column) -> Column:
    return F.coalesce(ext.isin(IMAGES) | mime.startswith("image/"), F.lit(False))


def is_archive(ext: Column, mime: Column) -> Column:
    types = "|".join(t.replace(".", r"\.") for t in ARCHIVE_TYPES)
    return F.coalesce(ext.isin(ARCHIVES) | F.lower(mime).rlike(f"^application/({types})"), F.lit(False))


def is_document(ext: Column, mime: Column) -> Column:
    return F.coalesce(ext.isin(DOCUMENTS) | mime.startswith("application/") | mime.startswith("text/"), F.lit(False))


def file_type_group(ext: Column, mime: Column) -> Column:
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("doc", "docx"), "docx")
        .when(ext.isin(SPREADSHEETS), "spreadsheet")
        .when(ext.isin(WEB_TEXTS) | mime.startswith("text/"), "html_text")
        .when(is_image(ext, mime), "images")
        .otherwise("other")
    )


def _bonus(label: str, low: Column, ext: Column, mime: Column) -> list[Column]:
    """(points, evidence) of a label's bonuses beside keywords; null where they don't apply."""

    def any_of(terms: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in terms))

    image = is_image(ext, mime)
    by_extension = {"spreadsheet": SPREADSHEETS, "markdown-note": ["md", "markdown"], "presentation": ["ppt", "pptx"], "source-code": CODE}
    by_image = {
        "screenshot": ["screenshot", "screen shot", "terminal", "console", "error"],
        "product-photo": ["product", "packaging", "bottle", "box", "label"],
        "reference-image": ["concept", "reference", "architecture", "environment", "facility", "industrial", "sci-fi"],
    }
    out = []

    def points(cond: Column, n: int, evidence: Column) -> None:
        out.append(F.when(cond, F.struct(F.lit(n).alias("points"), evidence.alias("evidence"))))

    if label in by_extension:
        points(ext.isin(by_extension[label]), 4, F.concat(F.lit("extension:"), ext))
    elif label in by_image:
        points(image & any_of(by_image[label]), 4, F.concat(F.lit("image:"), ext))
    elif label == "image-only":
        points(image, 2, F.concat(F.lit("image:"), ext))
    if label in ("technical", "markdown-note", "work", "report", "letter", "manual"):
        points(mime.startswith("text/"), 1, F.concat(F.lit("mime:"), mime))
    if label in ("report", "manual", "contract", "policy", "legal", "medical", "insurance", "financial"):
        points(mime.startswith("application/pdf"), 1, F.lit("mime:pdf"))
    return out


def ranked_labels(body: Column, ext: Column, mime: Column, rules: Rules) -> Column:
    """Array of (score, n_evidence, label, evidence), best first: score, then number of evidence, then label, all descending.
    A keyword gives 2 points (1 up to four letters)."""

    def one(label: str, words: list[str], low: Column) -> Column:
        hits = [F.when(F.contains(low, F.lit(w)), F.struct(F.lit(2 if len(w) > 4 else 1).alias("points"), F.lit(w).alias("evidence"))) for w in words]
        found = F.array_compact(F.array(*hits, *_bonus(label, low, ext, mime))) if label not in ("unknown", "needs-review") else F.array().cast("array<struct<points:int,evidence:string>>")
        points = lambda f: F.aggregate(f, F.lit(0), lambda a, x: a + x["points"])
        told = lambda f: F.array_distinct(F.transform(f, lambda x: x["evidence"]))
        return text.bound(found, lambda f: text.bound(told(f), lambda e: F.struct(points(f).alias("score"), F.size(e).alias("n_evidence"), F.lit(label).alias("label"), e.alias("evidence"))))

    # arrays are evaluated where they are named, so the text in lower case and what is found of each label are bound
    return text.bound(F.lower(body), lambda low: F.sort_array(F.array(*(one(label, words, low) for label, words in rules.items())), asc=False))


def boosted(ranked: Column, matches: Column) -> Column:
    """Ranked labels with external matches (label, score, evidence) added: at least 2 points each."""
    known = F.transform(ranked, lambda r: r["label"])
    raised = F.transform(
        ranked,
        lambda r: F.aggregate(
            F.filter(matches, lambda m: m["label"] == r["label"]),
            F.struct(r["score"].alias("score"), r["evidence"].alias("evidence")),
            lambda a, m: F.struct((a["score"] + F.greatest(F.lit(2), m["score"])).alias("score"), F.array_distinct(F.concat(a["evidence"], m["evidence"])).alias("evidence")),
            lambda a: F.struct(a["score"].alias("score"), F.size(a["evidence"]).alias("n_evidence"), r["label"].alias("label"), a["evidence"].alias("evidence")),
        ),
    )
    new = F.transform(F.filter(matches, lambda m: ~F.array_contains(known, m["label"])), lambda m: F.struct(F.greatest(F.lit(2), m["score"]).alias("score"), F.size(m["evidence"]).alias("n_evidence"), m["label"].alias("label"), m["evidence"].alias("evidence")))
    return F.sort_array(F.concat(raised, new), asc=False)


def teacher(df: DataFrame, ranked_col: str = "ranked", *, ext: str = "extension", mime: str = "mime_type", provider: str = "provider") -> DataFrame:
    """Adds teacher_primary, teacher_secondary, teacher_confidence, ambiguity_score and teacher_label."""
    top, runner = F.col(ranked_col)[0], F.col(ranked_col)[1]
    df = df.select("*", top["label"].alias("__top"), top["score"].alias("__s1"), runner["label"].alias("__second"), runner["score"].alias("__s2"), runner["n_evidence"].alias("__e2"))
    none = F.col("__s1") == 0
    image, sheet = is_image(F.col(ext), F.col(mime)), F.col(ext).isin(SPREADSHEETS)
    share = F.bround(F.col("__s1") / F.greatest(F.col("__s1") + F.col("__s2"), F.lit(1)), 4)
    primary = F.when(~none, F.col("__top")).when(image, "image-only").when(sheet, "spreadsheet").when(F.col(provider) == "icloud", "personal").when(F.col(provider).startswith("google"), "work").otherwise("unknown")
    confidence = F.when(~none, share).when(image, 0.25).when(sheet, 0.35).when((F.col(provider) == "icloud") | F.col(provider).startswith("google"), 0.25).otherwise(0.0)
    df = df.withColumns({"teacher_primary": primary, "teacher_confidence": confidence, "teacher_secondary": F.col("__second"), "ambiguity_score": F.greatest(F.lit(0), F.col("__s2") - F.col("__s1") + F.col("__e2"))})
    label = F.when(F.col("teacher_confidence") < 0.30, "unknown").when((F.col("teacher_confidence") < 0.45) & ~F.col("teacher_primary").isin("unknown", "needs-review"), "needs-review").otherwise(F.col("teacher_primary"))
    return df.withColumn("teacher_label", label).drop("__top", "__s1", "__second", "__s2", "__e2")


def provider_label(provider: Column, ext: Column, mime: Column) -> Column:
    cloud = provider == "icloud"
    return (
        F.when(is_image(ext, mime), F.when(cloud, "photo").otherwise("reference-image"))
        .when(ext.isin(SPREADSHEETS), "spreadsheet")
        .when(ext.isin("md", "markdown"), "markdown-note")
        .when(ext.isin(WEB_TEXTS), F.when(cloud, "personal").otherwise("work"))
        .when(cloud, "personal")
        .when(provider.startswith("google"), "work")
        .otherwise("unknown")
    )


def live_decision(heuristic_label: Column, heuristic_confidence: Column, model_label: Column, model_confidence: Column, needs_llm: Column, risk: Column, gating: dict[str, float] = GATING) -> Column:
    """Struct of use_inline_llm, live_source, selected_primary_hint and decision_reason."""
    h, m = text.canonical_label(heuristic_label), text.canonical_label(F.coalesce(model_label, heuristic_label))
    safe = (h == m) & (F.coalesce(heuristic_confidence, F.lit(0.0)) >= gating["heuristic_fast_confidence"]) & (F.coalesce(risk, F.lit(1.0)) < gating["disagreement_risk_threshold"])
    probability = F.coalesce(model_confidence, F.lit(0.0))
    strong = probability >= gating["model_fast_confidence"]
    soft = (probability >= gating["aligned_soft_confidence"]) & (F.coalesce(needs_llm, F.lit(1.0)) < gating["needs_llm_threshold"])
    fast = safe & (strong | soft)
    return F.struct((~fast).alias("use_inline_llm"), F.when(fast, "heuristic-fast-path").otherwise("inline-llm").alias("live_source"), F.when(fast, h).otherwise(m).alias("selected_primary_hint"), F.when(fast, "fast-path-aligned").otherwise("model-required").alias("decision_reason"))


def teacher_review(teacher_label: Column, confidence: Column, allowed: Column, live_label: Column, gating: dict[str, float] = GATING) -> Column:
    """Struct of review_status, approved, supports_live and suggests_correction. An empty candidate list allows all labels."""
    primary, live = F.coalesce(teacher_label, F.lit("unknown")), F.coalesce(live_label, F.lit("unknown"))
    sure = F.coalesce(confidence, F.lit(0.0)) >= gating["teacher_confidence_threshold"]
    inside = (F.size(allowed) <= 0) | F.array_contains(allowed, primary)
    status = F.when(~sure, "teacher-low-confidence").when(~inside, "teacher-outside-candidates").otherwise("teacher-approved")
    good = sure & inside
    return F.struct(status.alias("review_status"), good.alias("approved"), ((primary == live) & (inside | ~sure)).alias("supports_live"), (good & (primary != live) & (primary != "unknown")).alias("suggests_correction"))


def needs_review(label: Column, confidence: Column) -> Column:
    return F.coalesce(label, F.lit("unknown")).isin("unknown", "needs-review") | (F.coalesce(confidence, F.lit(0.0)) < REVIEW_CONFIDENCE)


def message_override(path: Column, label: Column, secondary: Column, markers: list[str]) -> Column:
    """Struct of primary and secondary labels: files under a message path become text-message, their old label secondary."""
    low = F.lower(path)
    hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in markers))
    merged = F.array_distinct(F.array_compact(F.concat(F.array(label), F.coalesce(secondary, F.array().cast("array<string>")))))
    moved = F.filter(merged, lambda x: ~x.isin("", "unknown", "needs-review", "text-message"))
    return F.struct(F.when(hit, F.lit("text-message")).otherwise(label).alias("primary"), F.when(hit, moved).otherwise(secondary).alias("secondary"))


def final_decision(path: Column, parser: Column, reviewed: Column, heuristic: Column, confidence: Column, model: Column, live: Column, *, forced: list[str], markers: list[str]) -> Column:
    """Struct of use_inline_llm, live_source, selected_primary_hint and decision_reason, from what ``live_decision`` gave. In this
    order: a reviewed label of the very source decides; without a rule's label the language model is asked; without a model's
    label the rule's one holds; pairs ``parser|label`` among ``forced`` are asked. A label that would then be taken but, moved to
    text-message where the path says so, needs review is asked as well. Null labels are missing ones."""
    quick, asked = F.lit("heuristic-fast-path"), F.lit("inline-llm")
    step = lambda ask, source, hint, reason: F.struct(ask.alias("use_inline_llm"), source.alias("live_source"), hint.alias("selected_primary_hint"), reason.alias("decision_reason"))
    key = F.concat(F.coalesce(parser, F.lit("")), F.lit("|"), heuristic)
    first = (
        F.when(heuristic.isNull(), step(F.lit(True), asked, F.coalesce(model, F.lit("unknown")), F.lit("no-heuristic-fast-path")))
        .when(model.isNull(), step(F.lit(False), quick, heuristic, F.lit("heuristic-without-lightgbm")))
        .when(key.isin(forced), step(F.lit(True), asked, live["selected_primary_hint"], F.lit("forced-inline-from-disagreement-config")))
        .otherwise(step(live["use_inline_llm"], live["live_source"], live["selected_primary_hint"], live["decision_reason"]))
    )
    preview = message_override(path, heuristic, F.array().cast("array<string>"), markers)["primary"]
    bound = ~first["use_inline_llm"] & needs_review(preview, confidence)
    last = F.when(bound, step(F.lit(True), asked, first["selected_primary_hint"], F.lit("review-bound-inline-llm"))).otherwise(first)
    return F.when(reviewed.isNotNull(), step(F.lit(False), F.lit("manual-correction-override"), reviewed, F.lit("exact-source-reviewed-feedback"))).otherwise(last)


def decided_labels(decision: Column, path: Column, reviewed: Column, heuristic: Column, inline: Column, markers: list[str]) -> Column:
    """Struct of primary and secondary labels after a ``final_decision``: those of the review as they are, without blanks, unknown
    and its own primary label; else those of the language model or the rule, moved to text-message where the path says so. The
    three are structs of primary and secondary; a null one gives unknown without secondary labels."""
    none = F.array().cast("array<string>")
    parts = lambda c: (F.coalesce(c["primary"], F.lit("unknown")), F.coalesce(c["secondary"], none))
    (own, more), (rule, rules), (told, tolds) = map(parts, (reviewed, heuristic, inline))
    kept = F.filter(F.array_distinct(F.array_compact(more)), lambda x: ~x.isin("", "unknown") & (x != own))
    asked = decision["use_inline_llm"]
    moved = message_override(path, F.when(asked, told).otherwise(rule), F.when(asked, tolds).otherwise(rules), markers)
    return F.when(decision["live_source"] == "manual-correction-override", F.struct(own.alias("primary"), kept.alias("secondary"))).otherwise(moved)


def fast_document_label(body: Column, terms: dict[str, list[str]], *, legal: int = 6, lead: int = 2, technical: int = 6, report: int = 4) -> Column:
    """legal, report or null by how many terms of each kind the text holds."""
    low = F.lower(F.coalesce(body, F.lit("")))
    n = {k: text.count_contained(low, v) for k, v in terms.items()}
    return F.when((n["legal"] >= legal) & (n["legal"] >= n["technical"] + lead), "legal").when((n["technical"] >= technical) & (n["report"] >= report), "report")


def fast_sheet_label(body: Column, terms: dict[str, list[str]], least: int = 2) -> Column:
    """The first kind, in the order given, of which the sheet holds ``least`` terms, or else spreadsheet."""
    low = F.lower(F.coalesce(body, F.lit("")))
    out = F.lit(None).cast("string")
    for kind, words in reversed(list(terms.items())):
        out = F.when(text.count_contained(low, words) >= least, F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit("spreadsheet"))


def normalized_classification(label: Column, secondary: Column, confidence: Column, allowed: list[str], cap: float = 0.69) -> Column:
    """Struct of label, secondary and confidence within the allowed set; labels outside become needs-review, capped."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    inside = low.isin(allowed)
    kept = F.filter(F.array_distinct(F.transform(secondary, lambda s: F.lower(F.trim(s)))), lambda s: s.isin(allowed) & (s != low))
    bounded = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.struct(F.when(inside, low).otherwise("needs-review").alias("label"), kept.alias("secondary"), F.when(inside, bounded).otherwise(F.least(bounded, F.lit(cap))).alias("confidence"))


def feature_text(fields: dict[str, Column]) -> Column:
    """Labelled fields that are not blank, one after the other."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{name}="), F.nullif(F.trim(value.cast("string")), F.lit(""))) for name, value in fields.items()))
