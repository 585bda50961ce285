"""Feedback of people: labels told by where notes lie and what their heads say, all feeds in one schema, requests that follow."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import paths, text

#: Folders of generated notes, and folders whose notes say nothing.
CLASSIFIED, REVIEW = "01 Classified", "02 Needs Review"
SKIPPED = [".obsidian", "_system"]

FolderMap = dict[str, tuple[str, list[str]]]

_BREAK = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029])"
_NO_BREAK = r"[^\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _strip(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\x0c\r"))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _strings(values: Column) -> Column:
    """Stripped values that are not blank; none for null."""
    stripped = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: _strip(F.coalesce(v, F.lit(""))))
    return F.filter(stripped, lambda v: v != "")


def note_entries(note: Column) -> Column:
    """Array of (key, raw), the ``key: value`` lines between a first line ``---`` and the next such line, in order."""
    head = F.regexp_extract(note, rf"(?s)\A[ \t]*---[ \t]*{_BREAK}((?:.*?{_BREAK})??)[ \t]*---[ \t]*(?:{_BREAK}|\z)", 1)
    lines = F.filter(F.split(F.coalesce(head, F.lit("")), _BREAK), lambda line: F.contains(line, F.lit(":")))
    return F.transform(lines, lambda line: F.struct(_strip(F.substring_index(line, ":", 1)).alias("key"), _strip(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)).alias("raw")))


def note_field(entries: Column, name: str) -> Column:
    """The last value of a key that is a JSON string or no JSON (quotes around it go); empty where there is none."""

    def value(entry: Column) -> Column:
        json = F.try_parse_json(entry["raw"])
        said = F.when(entry["raw"].startswith('"'), F.try_variant_get(json, "$", "string"))
        return F.when(json.isNull(), F.btrim(entry["raw"], F.lit("'\""))).otherwise(said)

    own = F.transform(F.filter(entries, lambda e: e["key"] == name), value)
    return F.coalesce(F.try_element_at(F.filter(own, lambda v: v.isNotNull()), F.lit(-1)), F.lit(""))


def note_list(entries: Column, name: str) -> Column:
    """The first value of a key as a JSON list of strings; anything else is empty."""
    raw = F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["raw"]
    return _strings(F.from_json(raw, "array<string>"))


def note_heading(note: Column) -> Column:
    """The text of the first line that begins with ``# ``; empty where there is none."""
    return _strip(F.regexp_extract(note, rf"(?:\A|{_BREAK})[ \t]*# [ \t]*([^\s]{_NO_BREAK}*)", 1))


def _token(name: str) -> str:
    """``text.folder_token`` of a name in the settings."""
    slug = re.sub("[^a-z0-9]+", "-", name.strip().lower()).strip("-")
    for end, other, pattern in (("ies", "y", ".+ies"), ("s", "", "..+[^s]s")):
        if re.fullmatch(pattern, slug):
            return slug[: -len(end)] + other
    return slug


def label_aliases(labels: list[str]) -> dict[str, str]:
    """Folder tokens that mean a label: the label, its token, and the token's plurals. Labels named first go first."""
    out: dict[str, str] = {}
    for label in filter(None, (x.strip() for x in labels)):
        token = _token(label)
        names = [label, token, "" if token.endswith("s") else f"{token}s", f"{token[:-1]}ies" if token.endswith("y") else ""]
        for name in names if token else names[:1]:
            if name:
                out.setdefault(name, label)
    return out


def _literal(entries: list[Column], type_: str) -> Column:
    return F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast(type_)


def folder_hint(parts: Column, labels: list[str], folder_map: FolderMap) -> Column:
    """Struct of primary_label, secondary_labels, match_source and matched_folder_key that folders tell; null where they tell
    nothing. The longest run of last folders that the map names decides; else folders that mean known labels, the last one
    first, up to two more as secondary labels. ``labels`` and the map are settings: they become literals of the plan."""
    mapped = {"/".join(filter(None, map(_token, key.split("/")))): (label.strip(), [s.strip() for s in more if s.strip()]) for key, (label, more) in folder_map.items()}
    known = _literal([F.struct(F.lit(k), F.struct(F.lit(p).alias("primary"), F.array(*map(F.lit, s)).cast("array<string>").alias("secondary"))) for k, (p, s) in mapped.items() if k and p], "map<string,struct<primary:string,secondary:array<string>>>")
    aliases = _literal([F.struct(F.lit(k), F.lit(v)) for k, v in label_aliases(labels).items()], "map<string,string>")

    def hint(tokens: Column) -> Column:
        n = F.size(tokens)
        keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "/"))
        key = F.get(F.filter(keys, lambda k: F.map_contains_key(known, k)), F.lit(0))
        meant = F.array_distinct(F.array_compact(F.transform(F.reverse(tokens), lambda t: F.try_element_at(aliases, t))))
        named = lambda primary, secondary, source, at: F.struct(primary.alias("primary_label"), secondary.alias("secondary_labels"), F.lit(source).alias("match_source"), at.alias("matched_folder_key"))
        entry = F.try_element_at(known, key)
        explicit = named(entry["primary"], entry["secondary"], "explicit-folder-map", key)
        return F.when(key.isNotNull(), explicit).when(F.size(meant) > 0, named(F.get(meant, F.lit(0)), F.slice(meant, 2, 2), "derived-folder-label", F.try_element_at(tokens, F.lit(-1))))

    return text.bound(F.filter(F.transform(parts, text.folder_token), lambda t: t != ""), hint)


def _last_part(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), F.lit(-1)), F.lit(""))


def manual_feedback(notes: DataFrame, *, labels: list[str], folder_map: FolderMap, parsed: DataFrame | None = None) -> DataFrame:
    """What people say by notes (path, relative_path, note_text): one row for each note that tells a label.

    A generated note (type classified-document) tells something if it was moved: its folder is not the one of its label, or it
    lies among the classified notes though it asks for review, or the other way round; and if that changes a label. Its own
    label is then the old one, and the feedback is strong. Other notes tell the label of their head (strong), or else of their
    folder (weak), or else that they are notes. ``parsed`` (source_path, parser, heuristic_primary), one row a source, gives what
    reading a source anew found, for generated notes whose head misses it. Null texts are empty ones; notes without a path or
    in skipped folders are left out."""
    c = F.col
    rows = notes.where("relative_path is not null").select("path", "relative_path", F.coalesce("note_text", F.lit("")).alias("note_text"))
    rows = rows.withColumn("parts", F.filter(F.split("relative_path", "/"), lambda p: ~p.isin("", ".")))
    rows = rows.where((F.size("parts") > 0) & ~F.get("parts", F.lit(0)).isin(SKIPPED)).withColumn("entries", note_entries(c("note_text")))
    fields = ["type", "primary_label", "old_label", "recommended_action", "canonical_source_path", "source_file", "source_parser", "heuristic_primary_hint", "hybrid_live_source"]
    rows = rows.select(
        "path", "relative_path", "parts", note_heading(c("note_text")).alias("heading"),
        *(note_field(c("entries"), f).alias(f"f_{f}") for f in fields), note_list(c("entries"), "secondary_labels").alias("own_secondary"),
    )
    root = F.when(F.get("parts", F.lit(0)).isin(CLASSIFIED, REVIEW) & (F.size("parts") >= 1), F.get("parts", F.lit(0)))
    folders = F.slice("parts", 1, F.size("parts") - 1)
    rows = rows.withColumns({"root": root, "folders": F.when(root.isNotNull() & (F.size("parts") > 1), F.slice(folders, 2, F.size("parts"))).otherwise(folders)})
    rows = rows.withColumns({
        "hint": folder_hint(c("folders"), labels, folder_map),
        "own": _filled(_strip(c("f_primary_label"))),
        "file": F.element_at("parts", -1),
        "generated": _strip(c("f_type")) == "classified-document",
        "source_path": F.coalesce(_filled(c("f_canonical_source_path")), _filled(c("f_source_file")), c("path")),
    })
    low = F.lower(F.coalesce("own", F.lit("")))
    appeal = (low == "medical") & F.arrays_overlap(F.transform("own_secondary", F.lower), F.array(F.lit("appeal"), F.lit("appeals")))
    expected = F.when(appeal, F.array(F.lit("medical"), F.lit("appeals"))).when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))
    action = F.lower(_strip(c("f_recommended_action")))
    crossed = ((c("root") == CLASSIFIED) & (action == "review")) | ((c("root") == REVIEW) & ~action.isin("", "review"))
    at_home = c("root").isNotNull() & (c("folders") == expected) & ~F.coalesce(crossed, F.lit(False))
    none = F.array().cast("array<string>")
    hinted = F.coalesce(c("hint.secondary_labels"), none)
    tokens = lambda values: F.array_distinct(F.filter(F.transform(values, text.folder_token), lambda t: t != ""))
    moved_to, old = F.coalesce(c("hint.primary_label"), c("own")), F.coalesce(c("own"), F.lit("unknown"))
    told = ~at_home & moved_to.isNotNull() & ~((moved_to == old) & (tokens(hinted) == tokens(c("own_secondary"))))
    rows = rows.where(F.when(c("generated"), told).otherwise(True))
    context = {"parser": F.lit(None).cast("string"), "heuristic": F.lit(None).cast("string")}
    if parsed is not None:
        found = parsed.select(c("source_path"), F.coalesce(_filled(_strip(c("parser"))), F.lit("unknown")).alias("p_parser"), F.coalesce(_filled(_strip(c("heuristic_primary"))), F.lit("unknown")).alias("p_heuristic"))
        rows = rows.join(found, "source_path", "left")
        context = {"parser": c("p_parser"), "heuristic": c("p_heuristic")}
    by = lambda generated, other: F.when(c("generated"), generated).otherwise(other)
    strong = c("own").isNotNull() | c("hint").isNull()
    return rows.select(
        by(F.concat(F.lit("generated:"), "source_path"), c("path")).alias("state_key"),
        "source_path",
        F.coalesce(_filled(_last_part(c("source_path"))), c("file")).alias("filename"),
        c("file").alias("source_filename"),
        by(moved_to, F.coalesce(c("own"), c("hint.primary_label"), F.lit("markdown-note"))).alias("correct_label"),
        by(old, F.coalesce(_filled(_strip(c("f_old_label"))), F.lit("unknown"))).alias("old_label"),
        by(hinted, F.when(c("own").isNotNull(), c("own_secondary")).otherwise(hinted)).alias("secondary_labels"),
        F.when(c("generated"), c("own_secondary")).alias("old_secondary_labels"),
        F.coalesce(_filled(c("heading")), paths.stem(c("file"))).alias("summary"),
        F.concat(by(F.lit("manual-note-move:"), F.lit("manual-obsidian-note:")), F.array_join("parts", "/")).alias("note"),
        by(F.coalesce(_filled(_strip(c("f_source_parser"))), context["parser"], F.lit("obsidian-generated-note")), F.lit("obsidian-markdown")).alias("parser"),
        F.when(c("generated"), F.coalesce(_filled(_strip(c("f_heuristic_primary_hint"))), context["heuristic"], F.lit("unknown"))).alias("heuristic_primary"),
        F.when(c("generated"), _strip(c("f_hybrid_live_source"))).alias("hybrid_live_source"),
        by(F.lit("manual-note-move"), F.when(strong, "manual-obsidian-note").otherwise("manual-folder-weak-label")).alias("review_status"),
        by(F.lit("strong"), F.when(strong, "strong").otherwise("weak")).alias("feedback_strength"),
        F.coalesce(c("hint.match_source"), F.lit("")).alias("folder_match_source"),
    )


def is_effective(status: Column, label: Column, old: Column, secondary: Column, old_secondary: Column) -> Column:
    """False for moves of notes that change neither the label nor, ignoring case and order, the secondary labels."""
    low = lambda values: F.array_sort(F.array_distinct(F.transform(_strings(values), F.lower)))
    same = (F.lower(_strip(status)) == "manual-note-move") & (_strip(label) != "") & (_strip(label) == _strip(old)) & (low(secondary) == low(old_secondary))
    return ~F.coalesce(same, F.lit(False))


#: Columns of a feed, strings but for those in the second list.
_FEED = ["recorded_at", "filename", "source_filename", "source_path", "parser", "heuristic_primary", "correct_label", "primary_label", "label", "old_label", "review_status", "summary", "note", "teacher_primary", "entity_summary", "topic_summary", "retrieval_text"]
_FEED_LISTS = ["secondary_labels", "old_secondary_labels", "teacher_evidence", "retrieval_terms"]


def bootstrap_feedback(feeds: dict[str, DataFrame], *, preview_chars: int = 4000) -> DataFrame:
    """Feeds of reviewed labels by name (corrections, examples, notes) in the schema of teacher feedback. A feed may lack any
    column; rows without a label, and moves that change nothing, are left out."""
    c = F.col
    parts = []
    for name, feed in feeds.items():
        given = [(F.col(n).cast(t) if n in feed.columns else F.lit(None).cast(t)).alias(n) for names, t in ((_FEED, "string"), (_FEED_LISTS, "array<string>")) for n in names]
        confidence = F.col("confidence").cast("double") if "confidence" in feed.columns else F.lit(None).cast("double")
        parts.append(feed.select(*given, confidence.alias("confidence"), F.lit(name).alias("feedback_source")))
    rows = reduce(DataFrame.unionByName, parts)
    first = lambda *names: F.coalesce(*(_filled(c(n)) for n in names))
    rows = rows.withColumn("accepted", _filled(_strip(first("correct_label", "primary_label", "label"))))
    rows = rows.where(c("accepted").isNotNull() & is_effective(F.coalesce("review_status", F.lit("")), c("accepted"), F.coalesce("old_label", F.lit("")), c("secondary_labels"), c("old_secondary_labels")))
    rows = rows.withColumn("filename", _strip(F.coalesce(first("filename", "source_filename"), _filled(_last_part(F.coalesce("source_path", F.lit("")))), F.lit("example"))))
    suffix = lambda value: F.lower(F.regexp_extract(_last_part(value), r".(\.[^.]+)$", 1))
    joined = lambda name: _filled(F.array_join(F.coalesce(name, F.array().cast("array<string>")), " "))
    preview = F.concat_ws(" ", *(_filled(c(n)) for n in ("source_path", "summary", "note", "old_label", "teacher_primary")), *(joined(n) for n in ("teacher_evidence", "secondary_labels", "retrieval_terms")))
    return rows.select(
        "recorded_at", "filename", F.coalesce(_filled(suffix(c("filename"))), suffix(F.coalesce(_filled(c("source_path")), c("filename")))).alias("extension"), F.coalesce("parser", F.lit("")).alias("parser"),
        F.coalesce(first("heuristic_primary", "old_label"), c("accepted")).alias("heuristic_primary"), c("accepted").alias("live_primary"), c("accepted").alias("shadow_primary"),
        F.coalesce("secondary_labels", F.array().cast("array<string>")).alias("taxonomy_candidates"), F.coalesce(first("review_status"), F.lit("teacher-approved-bootstrap")).alias("teacher_review_status"),
        F.lit("reviewed-corpus-bootstrap").alias("teacher_reason"), F.lit(True).alias("teacher_approved_for_training"), F.lit(True).alias("teacher_supports_live_result"),
        (_strip(F.coalesce("old_label", F.lit(""))) != "").alias("teacher_suggests_correction"), *(F.coalesce(n, F.lit("")).alias(n) for n in ("entity_summary", "topic_summary", "retrieval_text")),
        F.coalesce("retrieval_terms", F.array().cast("array<string>")).alias("retrieval_terms"), F.substring(preview, 1, preview_chars).alias("text_preview"), F.coalesce("confidence", F.lit(1.0)).alias("shadow_confidence"), "feedback_source",
    )


#: What a model's feedback must reach.
READINESS = {"samples": 10, "files": 10, "extensions": 4, "labels": 4, "agreement_rate": 0.80, "approval_rate": 0.70, "queue_depth": 25}


def readiness_report(rows: DataFrame, queue: DataFrame, *, model_exists: bool, allowed: bool = False, forced: bool = False, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row: counts and rates of teacher feedback, what it covers, whether all thresholds pass, and warnings in order. Rows
    are counted by kind and key first, so the last step reads distinct keys only; ``queue`` is what waits."""
    c, least = F.col, READINESS | (thresholds or {})
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("key"))
    filled = lambda value: _strip(F.coalesce(value, F.lit("")))
    approved = F.coalesce("teacher_approved_for_training", F.lit(False))
    label = filled(F.coalesce(*(_filled(c(n)) for n in ("shadow_primary", "live_primary", "heuristic_primary"))))
    none = F.lit(None)
    kinds = F.array(
        F.when(filled(c("teacher_review_status")) != "", key("reviewed", none)),
        *(F.when(approved, s) for s in (key("approved", none), key("source", F.coalesce(_filled(c("feedback_source")), F.lit("shadow"))))),
        F.when(approved & c("teacher_supports_live_result"), key("agreeing", none)),
        *(F.when(approved & (v != ""), key(k, v)) for k, v in (("file", filled(c("filename"))), ("extension", F.lower(filled(c("extension")))), ("label", label), ("parser", filled(c("parser"))))),
    )
    counted = rows.select(F.explode(F.array_compact(kinds)).alias("k")).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.unionByName(queue.agg(F.count(F.lit(1)).alias("n")).select(F.lit("queue").alias("kind"), F.lit(None).cast("string").alias("key"), "n"))
    total = lambda kind: F.coalesce(F.sum(F.when(c("kind") == kind, c("n"))), F.lit(0))
    listed = lambda kind: F.sort_array(F.collect_list(F.when(c("kind") == kind, c("key"))))
    found = counted.agg(
        total("reviewed").alias("reviewed"), total("approved").alias("samples"), total("agreeing").alias("agreeing"), total("queue").alias("queue_depth"), F.count_if(c("kind") == "file").alias("files"),
        listed("extension").alias("extension_list"), listed("label").alias("label_list"), listed("parser").alias("parser_list"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(c("kind") == "source", F.struct("key", "n"))))).alias("sources"),
    )
    share = lambda part, whole: F.when(c(whole) > 0, c(part) / c(whole)).otherwise(0.0)
    found = found.withColumns({"approval": share("samples", "reviewed"), "agreement": share("agreeing", "samples"), "extensions": F.size("extension_list"), "labels": F.size("label_list")})
    # fixed values: names of warnings, in order
    failed = {
        "lightgbm-model-missing": F.lit(not model_exists),
        "insufficient-teacher-approved-samples": c("samples") < least["samples"],
        "insufficient-unique-teacher-files": c("files") < least["files"],
        "insufficient-teacher-extension-coverage": c("extensions") < least["extensions"],
        "insufficient-teacher-label-coverage": c("labels") < least["labels"],
        "teacher-approval-rate-below-threshold": c("approval") < least["approval_rate"],
        "teacher-agreement-rate-below-threshold": c("agreement") < least["agreement_rate"],
        "shadow-queue-backlog-too-deep": c("queue_depth") > least["queue_depth"],
    }
    ready = ~reduce(lambda a, b: a | b, failed.values())
    failed |= {"manual-real-ingestion-enable-still-required": ready & F.lit(not allowed), "operator-real-ingestion-override-active": F.lit(forced)}
    return found.select(
        "reviewed", "samples", "agreeing", F.bround("approval", 6).alias("approval_rate"), F.bround("agreement", 6).alias("agreement_rate"), "files", "extension_list", "label_list", "parser_list", "sources", "queue_depth",
        ready.alias("thresholds_pass"), ((ready & F.lit(allowed)) | F.lit(forced)).alias("real_ingestion_allowed"), F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in failed.items()))).alias("warnings"),
    )
