"""The training dataset of labels: the corpus with its states, each record with what rules and aliases tell, and why a person
should look at it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.operators import labels, taxonomy

#: Words of sensitive topics, the topics in order.
SENSITIVE = {
    "medical": ["medical", "clinic", "hospital", "prescription", "pharmacy", "doctor", "patient", "health"],
    "legal": ["legal", "contract", "agreement", "policy", "clause", "terms", "court", "law", "notice"],
    "financial": ["financial", "bank", "statement", "account", "transaction", "balance", "payment", "invoice"],
    "insurance": ["insurance", "coverage", "deductible", "premium", "claim", "member", "policy"],
    "tax": ["tax", "irs", "1099", "w-2", "w2", "1040", "return", "withholding"],
    "bank": ["bank", "checking", "savings", "routing", "deposit", "withdrawal", "balance", "statement"],
    "appeal": ["appeal", "appealed", "appealing", "appeal letter", "appeal packet"],
    "benefits": ["benefits", "benefit", "coverage", "enrollment", "eob", "explanation of benefits"],
}

#: Columns of states that go into the corpus, under their names there.
_STATE = {
    "submission_status": "submission_status", "classifier_note_path": "classifier_note_path", "classifier_manifest_record": "classifier_manifest_record", "primary_label": "state_primary_label",
    "summary": "state_summary", "confidence": "state_confidence", "reasoning": "state_reasoning", "entity_summary": "entity_summary", "topic_summary": "topic_summary",
    "retrieval_terms_json": "retrieval_terms_json", "retrieval_text": "retrieval_text", "response_payload_json": "response_payload_json", "last_error": "last_error",
}


def _or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def training_corpus(files: DataFrame, contents: DataFrame, states: DataFrame, *, content_chars: int = 4000, limit: int | None = None) -> DataFrame:
    """Live files with the beginning of their text and their state, 20 columns; the first ``limit`` by id if one is given.
    Texts are cut, and a limit is taken, before anything is joined. States may lack columns, which are null then."""
    live = files.where(~F.coalesce("is_deleted", F.lit(False))).select("id", "external_id", "name", "path", "mime_type", _or_empty(F.col("extension")).alias("extension"))
    if limit is not None:
        live = live.orderBy("id").limit(max(limit, 0))
    texts = contents.select(F.col("file_id").alias("id"), F.substring("content_text", 1, content_chars).alias("content_text"))
    known = states.select(F.col("file_id").alias("id"), *((F.col(c) if c in states.columns else F.lit(None).cast("string")).alias(n) for c, n in _STATE.items()))
    rows = live.join(texts, "id", "left").join(known, "id", "left")
    return rows.withColumn("content_text", _or_empty(F.col("content_text")))


def _normal(*values: Column) -> Column:
    """Values that are not blank, in lower case, stripped and joined by single blanks."""
    return F.concat_ws(" ", *(F.nullif(F.btrim(F.lower(v), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) for v in values))


def annotate(records: DataFrame, rules: labels.Rules, aliases: DataFrame, *, matches: int = 8, boosts: int = 6, chars: int = 4000) -> DataFrame:
    """28 columns about each record (id, external_id, name, path, mime_type, extension, content_text), and ``matches`` (place,
    label, score, evidence) of the external aliases (local, alias), best first: the first ``boosts`` of them raise the rules'
    labels. Texts are taken to ``chars`` characters, as the corpus gives them. All other columns are carried. Ids are unique;
    null texts are empty."""
    c, ext, mime = F.col, F.col("extension"), F.col("mime_type")
    own = {"name": _or_empty(c("name")), "path": _or_empty(c("path")), "mime_type": _or_empty(mime), "content_text": F.substring(_or_empty(c("content_text")), 1, chars), "external_id": _or_empty(c("external_id"))}
    rows = records.withColumn("extension", F.coalesce(paths.extension(ext, c("name")), F.lit(""))).withColumns(own)
    rows = rows.withColumns({"provider": F.coalesce(F.lower(paths.provider(c("path"))), F.lit("unknown")), "query_text": _normal(c("name"), c("path"), c("content_text"))})
    found = taxonomy.match_aliases(rows.select("id", F.col("query_text").alias("content_text")), aliases, limit=matches)
    one = F.struct("place", "label", F.col("score").cast("int").alias("score"), "evidence")
    listed = found.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("matches"))
    rows = rows.join(listed, "id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(listed.schema["matches"].dataType)))
    raising = F.transform(F.filter("matches", lambda m: m["place"] <= boosts), lambda m: F.struct(m["label"].alias("label"), m["score"].alias("score"), m["evidence"].alias("evidence")))
    rows = rows.withColumns({"surface": labels.ranked_labels(_normal(c("name"), c("path")), ext, mime, rules)[0], "by_rules": labels.ranked_labels(c("query_text"), ext, mime, rules), "raising": raising})
    rows = labels.teacher(rows.withColumn("ranked", labels.boosted(c("by_rules"), c("raising"))))
    sheet, image = ext.isin(labels.SPREADSHEETS), labels.is_image(ext, mime)
    told = F.when(c("ranked")[0]["score"] > 0, c("ranked")[0]["evidence"]).when(image | sheet, F.array(F.lit("filetype"))).when((c("provider") == "icloud") | c("provider").startswith("google"), F.array(F.lit("provider"))).otherwise(F.array().cast("array<string>"))
    topics = F.array_compact(F.array(*(F.when(reduce(or_, (F.contains(c("query_text"), F.lit(w)) for w in words)), F.lit(t)) for t, words in SENSITIVE.items())))
    naive = labels.provider_label(c("provider"), ext, mime)
    points = c("surface.score")
    rows = rows.withColumns({
        "naive_label": F.when(naive != "unknown", naive).when(c("teacher_confidence") < 0.35, "needs-review").otherwise(c("teacher_primary")),
        "sensitive_topics": topics,
        "doc_like": labels.is_document(ext, mime),
        "image_like": image,
        "archive_like": labels.is_archive(ext, mime),
        "file_type_group": labels.file_type_group(ext, mime),
        "teacher_ranked_labels": F.transform(F.slice("ranked", 1, 5), lambda r: r["label"]),
        "teacher_evidence": told,
        "surface_primary": c("surface.label"),
        "surface_confidence": F.when(points > 0, F.bround(points / (points + 1), 4)).otherwise(0.0),
        "file_id": c("id"),
        "filename": F.coalesce(F.nullif(paths.base_name(c("name")), F.lit("")), F.lit("unknown")),
    })
    rows = rows.withColumns({"sample_eligible": ~c("archive_like"), "sensitive_hit": F.size("sensitive_topics") > 0, "sensitive_topic": F.coalesce(F.get("sensitive_topics", F.lit(0)), F.lit("")), "disagreement": c("naive_label") != c("teacher_label")})
    return rows.drop("surface", "by_rules", "raising", "ranked")


def training_dataset(annotated: DataFrame, *, preview_chars: int = 4000) -> DataFrame:
    """A row a record of the annotated corpus: canonical labels of the classifier, the teacher and the surface, the training
    target, and the reasons for a review in order. A classifier's label comes from the state, or else from the response, or else
    from the manifest; where it is missing or reserved, the target is the teacher's label."""
    c, canon = F.col, text.canonical_label
    said = lambda column, payload: F.coalesce(F.nullif(column, F.lit("")), F.get_json_object("response_payload_json", f"$.{payload}"), F.lit(""))
    raw = F.trim(F.coalesce(F.nullif(c("state_primary_label"), F.lit("")), F.nullif(F.get_json_object("response_payload_json", "$.primary_label"), F.lit("")), F.get_json_object("classifier_manifest_record", "$.primary_label"), F.lit("")))
    rows = annotated.withColumns({"raw_label": raw, "said_secondary": F.from_json(F.get_json_object("response_payload_json", "$.secondary_labels"), "array<string>"), "confidence_value": c("state_confidence").cast("double")})
    rows = rows.withColumns({"current": F.when(c("raw_label") != "", canon(c("raw_label"))).otherwise(""), "teacher_canonical": canon(c("teacher_label")), "primary_canonical": canon(c("teacher_primary"))})
    reserved, current = c("current").isin("unknown", "needs-review"), c("current")
    reasons = F.array_compact(F.array(
        F.when(current == "", F.lit("missing-classifier-label")).when(reserved, F.lit("classifier-review-label")),
        F.when((c("confidence_value") != 0) & (c("confidence_value") < 0.70), F.lit("classifier-low-confidence")),
        F.when(c("teacher_confidence") < 0.45, F.lit("teacher-low-confidence")),
        F.when((current != "") & ~reserved & (current != c("primary_canonical")), F.lit("teacher-current-disagreement")),
    ))
    return rows.withColumn("review_reasons", reasons).select(
        "file_id", "external_id", "filename", "path", "provider", "extension", "mime_type", "file_type_group",
        _or_empty(c("submission_status")).alias("submission_status"),
        _or_empty(c("classifier_note_path")).alias("classifier_note_path"),
        current.alias("classifier_primary_label"),
        c("raw_label").alias("classifier_primary_label_raw"),
        text.canonical_labels(c("said_secondary")).alias("classifier_secondary_labels"),
        F.bround("confidence_value", 4).alias("classifier_confidence"),
        said(c("state_summary"), "summary").alias("classifier_summary"),
        said(c("state_reasoning"), "reasoning").alias("classifier_reasoning"),
        said(c("entity_summary"), "entity_summary").alias("entity_summary"),
        said(c("topic_summary"), "topic_summary").alias("topic_summary"),
        text.string_list(c("retrieval_terms_json")).alias("retrieval_terms"),
        said(c("retrieval_text"), "retrieval_text").alias("retrieval_text"),
        _or_empty(c("last_error")).alias("last_error"),
        canon(c("naive_label")).alias("naive_label"),
        c("teacher_canonical").alias("teacher_label"),
        c("primary_canonical").alias("teacher_primary"),
        canon(c("teacher_secondary")).alias("teacher_secondary"),
        "teacher_confidence",
        text.canonical_labels(c("teacher_ranked_labels")).alias("teacher_ranked_labels"),
        "teacher_evidence",
        canon(c("surface_primary")).alias("surface_primary"),
        "surface_confidence", "ambiguity_score", "sensitive_topics",
        text.canonical_labels(F.transform("matches", lambda m: m["label"])).alias("taxonomy_candidates"),
        F.when((current == "") | reserved, c("teacher_canonical")).otherwise(current).alias("training_target_label"),
        (F.size("review_reasons") > 0).alias("review_recommended"),
        "review_reasons",
        F.substring("query_text", 1, preview_chars).alias("text_preview"),
    )


def dataset_report(rows: DataFrame, *, candidates: int = 20) -> DataFrame:
    """(metric, key, n) of a training dataset: its rows, those with a state, for review and in disagreement (key null), counts by
    provider, status, labels, target, type, topic and reason, and of the ``candidates`` commonest of first three candidates."""
    c = F.col
    at = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    none = F.lit(None).cast("string")
    counted = {
        "provider": c("provider"), "submission_status": F.coalesce(F.nullif("submission_status", F.lit("")), F.lit("unsubmitted")),
        "classifier_label": F.coalesce(F.nullif("classifier_primary_label", F.lit("")), F.lit("unclassified")), "teacher_label": c("teacher_label"),
        "training_target": c("training_target_label"), "file_type": c("file_type_group"),
    }
    flags = {"rows": F.lit(True), "with_state": c("submission_status") != "", "review_recommended": c("review_recommended"), "teacher_current_disagreement": F.array_contains("review_reasons", "teacher-current-disagreement")}
    lists = {"sensitive_topic": c("sensitive_topics"), "review_reason": c("review_reasons"), "taxonomy_candidate": F.slice("taxonomy_candidates", 1, 3)}
    single = F.array_compact(F.array(*(at(m, k) for m, k in counted.items()), *(F.when(f, at(m, none)) for m, f in flags.items())))
    listed = lambda metric, values: F.transform(values, lambda v: at(metric, v))
    each = F.concat(single, *(listed(m, values) for m, values in lists.items()))
    totals = rows.select(F.explode(each).alias("r")).groupBy("r.metric", "r.key").agg(F.count(F.lit(1)).alias("n"))
    best = totals.where("metric = 'taxonomy_candidate'").orderBy(F.desc("n"), "key").limit(candidates)
    return totals.where("metric <> 'taxonomy_candidate'").unionByName(best)
