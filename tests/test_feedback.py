"""Manual feedback on small notes whose outcome is plain."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import feedback

LABELS = ["report", "policy", "medical", "glass"]
FOLDERS = {"Old Invoices/2024": ("financial", ["invoice", " "]), "appeals": ("insurance", [])}


def _told(spark, *notes, parsed=None):
    rows = spark.createDataFrame([(f"/v/{p}" if p is not None else None, p, t) for p, t in notes], "path string, relative_path string, note_text string")
    return {r["source_filename"]: r for r in feedback.manual_feedback(rows, labels=LABELS, folder_map=FOLDERS, parsed=parsed).collect()}


def test_tokens_of_settings_and_rows_agree(spark):
    names = ["Reports", "  Policies ", "glass", "ies", "pies", "bus", "buses", "a&b's", "", "ss", "Über Falls", "x-ies"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", text.folder_token(F.col("name")).alias("t")).collect()
    assert {r["name"]: r["t"] for r in rows} == {n: feedback._token(n) for n in names}


def test_aliases_of_labels_keep_the_first():
    found = feedback.label_aliases(["policy", "policies", " ", "glass"])
    assert found == {"policy": "policy", "policys": "policy", "policies": "policy", "glass": "glass"}


def test_notes_without_heads_tell_weak_labels_or_none(spark):
    told = _told(
        spark,
        ("Reports/a.md", "text"),
        ("x/Old Invoices/2024/b.md", None),
        ("glass/Policies/Medical/e.md", ""),
        ("c.md", "  # Title \n# Other"),
        ("_system/d.md", "text"),
        (None, "text"),
    )
    assert set(told) == {"a.md", "b.md", "c.md", "e.md"}
    assert (told["a.md"]["correct_label"], told["a.md"]["feedback_strength"], told["a.md"]["folder_match_source"]) == ("report", "weak", "derived-folder-label")
    assert (told["b.md"]["correct_label"], told["b.md"]["secondary_labels"], told["b.md"]["folder_match_source"]) == ("financial", ["invoice"], "explicit-folder-map")
    assert (told["e.md"]["correct_label"], told["e.md"]["secondary_labels"]) == ("medical", ["policy", "glass"])
    assert (told["c.md"]["correct_label"], told["c.md"]["feedback_strength"], told["c.md"]["summary"], told["c.md"]["source_path"]) == ("markdown-note", "strong", "Title", "/v/c.md")
    assert told["a.md"]["summary"] == "a" and told["a.md"]["note"] == "manual-obsidian-note:Reports/a.md" and told["a.md"]["old_label"] == "unknown"


def _note(label, *, action="", secondary="[]", extra=""):
    return f'---\r\ntype: "classified-document"\r\nprimary_label: "{label}"\r\nsecondary_labels: {secondary}\r\nrecommended_action: {action}\r\nsource_file: /s/{label}.pdf\r\n{extra}---\r\nbody'


def test_generated_notes_tell_only_what_changed(spark):
    told = _told(
        spark,
        ("01 Classified/report/same.md", _note("report")),
        ("01 Classified/medical/appeals/home.md", _note("medical", secondary='["Appeal"]')),
        ("02 Needs Review/report/reviewed.md", _note("report", action="archive", secondary='["glass"]')),
        ("02 Needs Review/report/waiting.md", _note("report", action="review", secondary='["glass"]')),
        ("01 Classified/Policies/moved.md", _note("report", extra="source_parser: docx\r\n")),
        ("Reports/equal.md", _note("report")),
        ("01 Classified/zzz/nothing.md", _note("")),
    )
    assert set(told) == {"reviewed.md", "moved.md"}
    moved = told["moved.md"]
    assert (moved["correct_label"], moved["old_label"], moved["parser"], moved["heuristic_primary"], moved["hybrid_live_source"]) == ("policy", "report", "docx", "unknown", "")
    assert (moved["state_key"], moved["filename"], moved["review_status"], moved["note"]) == ("generated:/s/report.pdf", "report.pdf", "manual-note-move", "manual-note-move:01 Classified/Policies/moved.md")
    assert (told["reviewed.md"]["secondary_labels"], told["reviewed.md"]["old_secondary_labels"]) == ([], ["glass"])


def test_sources_read_anew_fill_what_heads_miss(spark):
    parsed = spark.createDataFrame([("/s/report.pdf", "", "legal")], "source_path string, parser string, heuristic_primary string")
    told = _told(spark, ("Policies/m.md", _note("report")), ("Policies/n.md", _note("glass")), parsed=parsed)
    assert (told["m.md"]["parser"], told["m.md"]["heuristic_primary"]) == ("unknown", "legal")
    assert (told["n.md"]["parser"], told["n.md"]["heuristic_primary"]) == ("obsidian-generated-note", "unknown")


def test_fields_of_heads(spark):
    note = "---\nprimary_label: 5\nprimary_label: 'a: b'\nother: [\"x\"]\nold_label: \"q\\\"r\"\nnone\nlist: [\"x\", 1, \" \", null]\nlist: [\"y\"]\n---\n# T"
    e = feedback.note_entries(F.col("t"))
    rows = spark.createDataFrame([(note,), ("no head\n---\na: b\n---",), ("---\na: b",), (None,), ("---\n---\n# x",)], "t string")
    got = rows.select(*(feedback.note_field(e, n).alias(n) for n in ("primary_label", "other", "old_label", "a")), feedback.note_list(e, "list").alias("list"), F.coalesce(feedback.note_heading(F.col("t")), F.lit("")).alias("h")).collect()
    assert tuple(got[0]) == ("a: b", "", 'q"r', "", ["x", "1"], "T")
    assert [tuple(r) for r in got[1:]] == [("", "", "", "", [], ""), ("", "", "", "", [], ""), ("", "", "", "", [], ""), ("", "", "", "", [], "x")]


def test_an_empty_table_tells_nothing(spark):
    assert _told(spark) == {}


def test_feeds_of_any_columns_in_one_schema(spark):
    notes = spark.createDataFrame(
        [(" tax ", "tax", "manual-note-move", ["A", "b"], ["B ", "a"]), ("tax", "tax", "manual-note-move", ["a"], None), ("bank", None, None, None, None), (" ", "x", None, None, None)],
        "correct_label string, old_label string, review_status string, secondary_labels array<string>, old_secondary_labels array<string>",
    )
    examples = spark.createDataFrame([("note", "/s/a.b.TXT", 0.5, 1), (None, "/s/c", 0.1, 2)], "label string, source_path string, confidence double, other int")
    got = feedback.bootstrap_feedback({"example": examples, "notes": notes, "none": notes.limit(0)}).orderBy("feedback_source", "live_primary").collect()
    assert [(r["feedback_source"], r["filename"], r["extension"], r["live_primary"], r["heuristic_primary"], r["teacher_suggests_correction"], r["shadow_confidence"]) for r in got] == [
        ("example", "a.b.TXT", ".txt", "note", "note", False, 0.5),
        ("notes", "example", "", "bank", "bank", False, 1.0),
        ("notes", "example", "", "tax", "tax", True, 1.0),
    ]
    assert got[2]["text_preview"] == "tax a" and got[2]["taxonomy_candidates"] == ["a"]


def test_readiness_names_what_fails(spark):
    schema = "filename string, extension string, parser string, shadow_primary string, live_primary string, heuristic_primary string, teacher_review_status string, teacher_approved_for_training boolean, teacher_supports_live_result boolean, feedback_source string"
    good = [(f"f{i}", f".E{i % 4}", "p", None, "", f"l{i % 4}", "approved", True, i > 1, None) for i in range(10)]
    queue = spark.range(25)
    last = lambda rows, queue=queue, **options: feedback.readiness_report(spark.createDataFrame(rows, schema), queue, **{"model_exists": True} | options).first()
    r = last(good)
    assert (r["thresholds_pass"], r["real_ingestion_allowed"], r["warnings"], r["sources"]) == (True, False, ["manual-real-ingestion-enable-still-required"], {"shadow": 10})
    assert (r["agreement_rate"], r["extension_list"], r["label_list"]) == (0.8, [".e0", ".e1", ".e2", ".e3"], ["l0", "l1", "l2", "l3"])
    assert last(good, allowed=True)["warnings"] == [] and last(good, allowed=True)["real_ingestion_allowed"]
    bad = last([*good, *[("g", "", "", "", "", "", "rejected", False, None, None)] * 5], spark.range(26), model_exists=False, forced=True)
    assert bad["warnings"] == ["lightgbm-model-missing", "teacher-approval-rate-below-threshold", "shadow-queue-backlog-too-deep", "operator-real-ingestion-override-active"]
    assert bad["real_ingestion_allowed"] and not bad["thresholds_pass"]
    empty = last([], spark.range(0))
    assert len(empty["warnings"]) == 6 and (empty["samples"], empty["approval_rate"], empty["sources"]) == (0, 0.0, {})
