"""The training dataset on odd records."""

from __future__ import annotations

from docweave.operators import dataset

RULES = {"legal": ["clause"], "tax-form": ["1099"], "spreadsheet": [], "unknown": []}
FILE = "id long, external_id string, name string, path string, mime_type string, extension string, is_deleted boolean, extra string"


def _dataset(spark, files, contents=(), states=(), state_schema="file_id long, primary_label string, confidence double, response_payload_json string, classifier_manifest_record string", **options):
    f = spark.createDataFrame(list(files), FILE)
    c = spark.createDataFrame(list(contents), "file_id long, content_text string")
    s = spark.createDataFrame(list(states), state_schema)
    corpus = dataset.training_corpus(f, c, s, **options)
    aliases = spark.createDataFrame([("legal", "old clause"), ("tax", "tax return")], "local string, alias string")
    return corpus, dataset.annotate(corpus, RULES, aliases), {r["file_id"]: r for r in dataset.training_dataset(dataset.annotate(corpus, RULES, aliases)).collect()}


def test_labels_come_from_state_response_or_manifest(spark):
    files = [(i, f"e{i}", f"a{i}.PDF", f"/Google/a{i}.PDF", "application/pdf", None, False, "x") for i in range(5)]
    states = [(0, "Receipt", 0.9, None, None), (1, "", 0.5, '{"primary_label": "bank", "secondary_labels": ["Claim", "hsa", "fsa"], "summary": "s"}', None), (2, None, None, "broken", '{"primary_label": " note "}'), (3, "unknown", 0.0, '{"secondary_labels": "x"}', None)]
    corpus, annotated, got = _dataset(spark, files, [(0, "An old clause. tax return 1099"), (1, None)], states)
    assert len(corpus.columns) == 20
    assert {"disagreement", "query_text", "sample_eligible", "archive_like"} <= set(annotated.columns)
    assert [got[i]["classifier_primary_label"] for i in range(5)] == ["financial", "financial", "note", "unknown", ""]
    assert (got[1]["classifier_secondary_labels"], got[1]["classifier_summary"], got[1]["extension"]) == (["insurance", "financial"], "s", "pdf")
    assert got[3]["classifier_secondary_labels"] == []
    # the rule gives 2 points, its type 1, the alias 4; the second label has only an alias
    assert (got[0]["teacher_primary"], got[0]["teacher_secondary"], got[0]["teacher_confidence"], got[0]["teacher_evidence"]) == ("legal", "tax", 0.6364, ["clause", "mime:pdf", "old clause"])
    assert got[0]["taxonomy_candidates"] == ["legal", "tax"] and got[0]["sensitive_topics"] == ["legal", "tax"]
    assert got[0]["review_reasons"] == ["teacher-current-disagreement"]
    assert got[1]["review_reasons"][0] == "classifier-low-confidence" and got[3]["review_reasons"][0] == "classifier-review-label" and got[4]["review_reasons"][0] == "missing-classifier-label"
    assert got[1]["training_target_label"] == "financial" and got[4]["training_target_label"] == got[4]["teacher_label"]


def test_odd_records_have_defined_rows(spark):
    files = [(1, None, None, None, None, None, None, None), (2, "e", ".hidden", "x", "", " .ZIP ", False, ""), (3, "e", "gone.txt", "/a", "text/plain", "txt", True, "")]
    _, annotated, got = _dataset(spark, files)
    assert set(got) == {1, 2}
    assert (got[1]["filename"], got[1]["provider"], got[1]["teacher_label"], got[1]["teacher_confidence"], got[1]["naive_label"], got[1]["text_preview"]) == ("unknown", "unknown", "unknown", 0.0, "needs-review", "")
    rows = {r["file_id"]: r for r in annotated.collect()}
    assert (rows[2]["archive_like"], rows[2]["sample_eligible"], rows[2]["extension"], rows[2]["doc_like"]) == (True, False, "zip", False)


def test_limits_texts_and_missing_state_columns(spark):
    files = [(i, "e", "n.csv", "/icloud/n.csv", "text/csv", "csv", False, "") for i in (3, 1, 2)]
    corpus, _, got = _dataset(spark, files, [(1, "x" * 9000)], [(1, "report")], "file_id long, primary_label string", limit=2)
    assert set(got) == {1, 2} and {len(r["content_text"]) for r in corpus.collect()} == {4000, 0}
    assert (got[1]["classifier_confidence"], got[1]["submission_status"], got[1]["naive_label"], got[1]["teacher_primary"]) == (None, "", "spreadsheet", "spreadsheet")


def test_an_empty_corpus_has_an_empty_report(spark):
    _, annotated, got = _dataset(spark, [])
    assert got == {} and dataset.dataset_report(dataset.training_dataset(annotated)).collect() == []
