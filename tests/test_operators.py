"""Operators, readers and streaming jobs that no query with SQL covers, against plain expectations on small tables."""

from __future__ import annotations

import datetime
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.functions import paths, text
from docweave.operators import dedupe, labels, queueing, reconcile, reports, status, taxonomy, training
from docweave.sources import readers
from docweave.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def column(rows, name):
    return sorted(r[name] for r in rows.collect())


# --- training


def mined(rows, specs, quota):
    taken, out = set(), []
    for label, words in specs.items():
        own = [(i, p) for i, p, t in sorted(rows) if any(w in t.lower() for w in words) and p not in taken][:quota]
        taken |= {p for _, p in own}
        out += [(i, p, label) for i, p in own]
    return sorted(out)


def test_mining_of_many_labels(spark):
    """As many labels as a deployment has stay one small plan."""
    rng = random.Random(3)
    specs = {f"label{i}": [f"word{i}", f"other{i} "] for i in range(43)}
    rows = [(i, f"/p/{i // 2 if i % 9 == 0 else i}", " ".join(rng.choice(["Word", "other"]) + f"{rng.randrange(43)} x" for _ in range(4))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, path string, content_text string").repartition(3)
    got = training.mine_examples(df, specs, 4)
    assert sorted(tuple(r) for r in got.select("id", "path", "label").collect()) == mined(rows, specs, 4)


def test_stratified_sample(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(40)], "id long, kind string, n int")
    buckets = [("a", F.col("kind") == "a", 5), ("small", F.col("n") < 10, 6), ("rest", F.lit(True), 100)]
    order = {r["id"]: (r["h0"], r["h1"], r["h2"]) for r in rows.select("id", *(F.xxhash64("id", F.lit(13 + i)).alias(f"h{i}") for i in range(3))).collect()}
    taken: dict[int, str] = {}
    for k, (name, fits, quota) in enumerate([("a", lambda i: i % 2 == 0, 5), ("small", lambda i: i < 10, 6), ("rest", lambda i: True, 100)]):
        for i in sorted((i for i in range(40) if fits(i) and i not in taken), key=lambda i: (order[i][k], i))[:quota]:
            taken[i] = name
    got = training.stratified_sample(rows, buckets, 13)
    assert {r["id"]: r["bucket"] for r in got.collect()} == taken and got.count() == 40


def test_counts_by_weight():
    assert training.equal_counts(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2}
    assert training.weighted_counts(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert training.weighted_counts(10, {"a": 0}) == {"a": 0}


def test_retrain_gate(spark):
    seen = spark.createDataFrame([(True, "2024-02-01")] * 6, "manual boolean, recorded_at string")
    row = training.retrain_gate(seen, 5, least_rows=5, least_new=3, manual_since=F.lit("2024-01-01")).first()
    assert (row["rows"], row["new_rows"], row["retrain"]) == (6, 1, True)
    assert training.updated_threshold(0.76) == 0.75


def test_router_rows(spark):
    docs = spark.createDataFrame([("a bill", "bank"), (" ", "bank")], "text string, label string")
    aliases = spark.createDataFrame([("health-care", "clinic")], "local string, alias string")
    got = training.router_rows(docs, aliases, docs.limit(0))
    assert sorted((r["text"], r["label"]) for r in got.collect()) == [("a bill", "bank"), ("clinic", "health-care"), ("clinic record", "health-care"), ("document about clinic", "health-care"), ("document about health care", "health-care"), ("health care", "health-care"), ("health care record", "health-care")]


def test_image_labels(spark):
    given = F.array(*map(F.lit, ["zebra", "technical", "photo", "marketing", "architecture", "zebra"]))
    assert value(spark, status.image_labels(given, F.lit("IMG_1.png"))) == ["architecture", "photo", "zebra"]
    assert value(spark, status.image_labels(given, F.lit("Screenshot.png"))) == ["architecture", "photo", "zebra", "technical"]


def test_refresh_waits_for_pause_and_interval(spark):
    runs = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "completed_at timestamp")
    at = lambda m: F.lit(f"2024-01-01 00:{m}:00").cast("timestamp")
    none = runs.limit(0)
    assert [status.refresh_due(r, a, at(m), paused=p).first()["due"] for r, a, m, p in ((runs, none, 29, False), (runs, none, 30, False), (runs, none, 30, True), (runs, runs, 30, False), (none, none, 10, False))] == [False, True, False, False, True]


# --- taxonomy


def test_aliases_of_any_length(spark):
    docs = spark.createDataFrame([(1, "A quick, brown fox jumps over the lazy dog & cat"), (2, "the quick brown"), (3, None)], "id long, content_text string")
    aliases = spark.createDataFrame([("animal", "quick brown fox jumps over the lazy dog and cat"), ("animal", "fox"), ("speed", "quick brown"), ("none", "brown the")], "local string, alias string")
    want = [(1, "animal", 8, ["fox", "quick brown fox jumps over the lazy dog and cat"], 1), (1, "speed", 4, ["quick brown"], 2), (2, "speed", 4, ["quick brown"], 1)]
    for chunk_bytes in (16 << 20, 20):
        got = taxonomy.match_aliases(docs, aliases, chunk_bytes=chunk_bytes)
        assert sorted(tuple(r) for r in got.collect()) == want
    hints = {r["id"]: r["hint"] for r in taxonomy.hint_text(got).collect()}
    assert hints[2] == "speed quick brown"


def test_many_aliases_and_none(spark):
    docs = spark.createDataFrame([(i, f"alias {i} of many") for i in range(0, 50_000, 5_000)] + [(-1, ""), (-2, None)], "id long, content_text string")
    many = spark.range(50_000).select(F.lit("x").alias("local"), F.concat(F.lit("alias "), "id").alias("alias"))
    assert column(taxonomy.match_aliases(docs, many), "id") == list(range(0, 50_000, 5_000))
    assert taxonomy.match_aliases(docs, many.limit(0)).collect() == []


def test_quoted_csv_fields(spark):
    lines = spark.createDataFrame([('1,"Home, Garden"',), ('2,"say ""hi"", twice" ',), ("3,plain",), ("lone",), ('"a,b",',)], "value string")
    assert column(taxonomy.csv_last_column(lines), "label") == sorted(["Home, Garden", 'say "hi", twice', "plain", "lone"])


def test_taxonomy_readers(spark):
    lines = spark.createDataFrame([("1,Home, Garden ",), ("2,,",), ("A > B > C",), ("x\ty\tz\t",)], "value string")
    assert column(taxonomy.csv_last_column(lines.limit(2)), "label") == ["Garden"]
    assert ("C", "B > C") in [tuple(r) for r in taxonomy.breadcrumb_labels(lines).collect()]
    assert "z" in column(taxonomy.tiered_labels(lines), "label")
    external = spark.createDataFrame([("Medical Claims",), ("Claims",), ("Boats",)], "label string")
    local = spark.createDataFrame([("claim", "claims"), ("health", "medical")], "local string, keyword string")
    mapped = taxonomy.map_to_local(external, local)
    assert sorted(tuple(r) for r in mapped.collect()) == [("Claims", "claim"), ("Medical Claims", "claim"), ("Medical Claims", "health")]
    built = taxonomy.build_aliases(mapped, blocked=["claims"], blocked_by_label={"health": ["medical claims"]})
    assert sorted(tuple(r) for r in built.collect()) == [("claim", "medical claims")]


def test_candidate_categories(spark):
    arrays = [F.array(*map(F.lit, x)) for x in (["a", "z"], ["b", "a"], ["c"])]
    assert value(spark, taxonomy.candidate_categories(*arrays, allowed=["a", "b", "c"])) == ["a", "b", "c", "unknown", "needs-review"]


# --- labels


def test_provider_and_fast_labels(spark):
    rows = [("icloud", "jpg", "photo"), ("google1", "png", "reference-image"), ("icloud", "xlsx", "spreadsheet"), ("google1", "md", "markdown-note"), ("icloud", "html", "personal"), ("google2", "html", "work"), ("icloud", "pdf", "personal"), ("other", "pdf", "unknown")]
    df = spark.createDataFrame(rows, "provider string, extension string, want string")
    got = df.select("want", labels.provider_label(F.col("provider"), F.col("extension"), F.lit("application/x")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    terms = {"legal": ["court", "clause"], "technical": ["code"], "report": ["summary"]}
    assert value(spark, labels.fast_document_label(F.lit("Court clause"), terms, legal=2, lead=1)) == "legal"
    assert value(spark, labels.fast_document_label(F.lit("Code summary"), terms, legal=2, technical=1, report=1)) == "report"
    assert value(spark, labels.fast_document_label(F.lit(None).cast("string"), terms)) is None
    kinds = {"tax": ["w-2", "irs"], "bank": ["balance", "deposit"]}
    assert value(spark, labels.fast_sheet_label(F.lit("IRS w-2 balance deposit"), kinds)) == "tax"
    assert value(spark, labels.fast_sheet_label(F.lit("balance"), kinds)) == "spreadsheet"


def test_normalized_classification(spark):
    got = value(spark, labels.normalized_classification(F.lit(" Tax "), F.array(F.lit("bank"), F.lit("TAX"), F.lit("x")), F.lit(1.7), ["tax", "bank"]))
    assert (got["label"], got["secondary"], got["confidence"]) == ("tax", ["bank"], 1.0)
    got = value(spark, labels.normalized_classification(F.lit("odd"), F.array().cast("array<string>"), F.lit(0.9), ["tax"]))
    assert (got["label"], got["confidence"]) == ("needs-review", 0.69)
    assert value(spark, labels.feature_text({"name": F.lit("a"), "path": F.lit(" "), "n": F.lit(3)})) == "name=a n=3"


# --- duplicates


def test_exact_hash_from_crawled_bytes(spark, tmp_path):
    """Bytes of live files give the strategy its hash."""
    for name, body in (("Docs/A.pdf", b"same"), ("Other/A-copy.pdf", b"same"), ("Docs/B.pdf", b"else")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    files = readers.crawl(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(/(?:Docs|Other)/.*)$", 1))
    files = files.withColumn("id", F.xxhash64("path")).withColumn("is_deleted", F.lit(False))
    hashes = files.select(F.col("id").alias("file_id"), F.lit(None).cast("string").alias("content_hash"), F.sha2("content", 256).alias("byte_hash"))
    found = dedupe.run(files.drop("content"), hashes, strategies=["exact_hash"])
    assert [(r["duplicate_count"], r["confidence"]) for r in found.collect()] == [(1, 0.99)]
    assert dedupe.run(files.drop("content"), hashes, strategies=["exact_hash"], namespaces=["Docs"]).count() == 0


def test_apply_errors(spark):
    found = spark.createDataFrame([("g", "content_hash", 0.93, 1), ("h", "normalized_name_size", 0.55, 2)], "group_id string, strategy string, confidence double, keep_id long")
    moves = spark.createDataFrame([("g", 1, [2]), ("g", 1, [1, 2]), ("g", 2, [1]), ("h", 2, [3]), ("x", 1, [2])], "group_id string, keep_id long, move_ids array<long>")
    got = sorted(str(r["error"]) for r in dedupe.apply_errors(moves, found).collect())
    assert got == ["None", "confidence too low", "keep is in the move list", "not the recommended keep", "unknown group"]


# --- functions


def test_text_functions(spark):
    assert value(spark, text.utc(F.lit("2024-01-01T10:00:00Z"))) == datetime.datetime(2024, 1, 1, 10)
    assert value(spark, text.utc(F.lit("no time"))) is None
    assert value(spark, text.age_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:00").cast("timestamp"))) == 60
    assert value(spark, text.string_list(F.lit('["a", "A ", "b"]'))) == ["a", "b"]
    assert value(spark, text.string_list(F.lit("no"))) == []
    assert value(spark, text.split_list(F.lit("a, ,b"))) == ["a", "b"]
    assert value(spark, text.canonical_label(F.lit(None).cast("string"))) == "unknown"
    assert value(spark, paths.relative_path(F.lit("/a/b/c.txt"))) == "b/c.txt"


# --- readers


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\nbad\n{"n": 2}\n\n{"n": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 9}\n')
    assert column(readers.json_lines(spark, str(tmp_path), "n int"), "n") == [1, 2, 3, 9]
    assert column(readers.json_lines(spark, str(tmp_path), "n int", last=2), "n") == [2, 3, 9]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text(json.dumps([{"n": 1}, {"n": 2}], indent=1))
    assert column(readers.json_document(spark, str(tmp_path / "d"), "n int"), "n") == [1, 2]


def test_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "n int")
    for _ in range(2):
        readers.append_json(rows, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    readers.overwrite_json(rows, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 1


def test_crawl_and_notes(spark, tmp_path):
    for name in ("a/x.TXT", "venv/y.txt", "a/.git/z.txt", "n.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('---\ntype: "note"\nkey: v\n---\nbody' if name.endswith("md") else "hello")
    assert column(readers.crawl(spark, str(tmp_path)), "name") == ["n.md", "x.TXT"]
    note = readers.notes(spark, str(tmp_path)).first()
    assert note["metadata"] == {"type": "note", "key": "v"} and note["body"] == "body"
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.extracted(readers.crawl(spark, str(tmp_path))).collect()}
    assert got["x.TXT"] == "hello"


def test_normalize_item(spark):
    raw = spark.createDataFrame([(7, "A.PDF", "/x/A.PDF", "PDF", "application/pdf", 3, "2024-01-01T00:00:00")], "id int, name string, path string, extension string, contentType string, size int, modified string")
    row = readers.normalize_item(raw).first()
    assert (row["external_id"], row["extension"], row["mime_type"], row["size_bytes"]) == ("7", "pdf", "application/pdf", 3)


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_texts(spark):
    w, s = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Three</w:t></w:p></w:document>'})
    sheet = f'<worksheet xmlns="{s}"><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></worksheet>'
    xlsx = _zip({"xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>shared</t></si></sst>', "xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="Data"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet})
    df = spark.createDataFrame([(bytearray(docx), bytearray(xlsx), bytearray(b"broken"))], "d binary, x binary, b binary")
    row = df.select(readers.docx_text("d").alias("d"), readers.xlsx_text("x").alias("x"), readers.sheet_preview("x").alias("p"), readers.docx_text("b").alias("b")).first()
    assert tuple(row) == ("One two\nThree", "shared\n5\nin", "## Data\n| shared | 5 |\n| in |", "")


def test_choice_of_text_and_json_in_text(spark):
    assert value(spark, readers.choose_text(F.lit("short"), F.lit("a longer scanned text"))) == "a longer scanned text"
    assert value(spark, readers.choose_text(F.lit("x" * 90), F.lit("y" * 100))) == "x" * 90
    rows = spark.createDataFrame([('say {bad {"a": {"b": 1}} {"c": 2}',), ("none",), (None,)], "t string")
    assert [r["j"] for r in rows.select(readers.first_json_object("t").alias("j")).collect()] == ['{"a": {"b": 1}}', None, None]


# --- streaming


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.files_stream(spark, f"{folder}/in", schema, per_trigger=1)


def test_batches_resume(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1,)], [(2,)]], "n int")
    for _ in range(2):
        jobs.run_available(stream, f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out")).awaitTermination(60)
    assert column(spark.read.parquet(f"{tmp_path}/out"), "n") == [1, 2]


def test_change_detection(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z")]], "key string, seq long, fingerprint string")
    jobs.run_available(jobs.changes(stream), f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out")).awaitTermination(90)
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").select("key", "seq", "fingerprint", "change").collect()) == [("a", 1, "x", "new"), ("a", 3, "y", "changed"), ("b", 1, "z", "new")]


def test_events_once(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[("e", "2024-01-01 00:00:00"), ("e", "2024-01-01 00:00:00"), ("f", "2024-01-01 00:00:05")]], "id string, at string")
    once = jobs.new_events(stream.withColumn("at", F.col("at").cast("timestamp")), ["id"], "at", "1 minute")
    jobs.run_available(once, f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out")).awaitTermination(60)
    assert column(spark.read.parquet(f"{tmp_path}/out"), "id") == ["e", "f"]


def test_leases_end(spark, tmp_path):
    at = "2024-01-01 00:{:02d}:00"
    stream = stream_of(spark, tmp_path, [[("a", at.format(0)), ("b", at.format(0))], [("a", at.format(4))], [("c", at.format(20))]], "job string, at string")
    ended = jobs.lease_expiry(stream.withColumn("at", F.col("at").cast("timestamp")), "at", 300)
    jobs.run_available(ended, f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out")).awaitTermination(90)
    start = 1704067200000
    assert sorted((r["job"], r["last_beat_ms"] - start) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 240_000), ("b", 0)]


def test_pause_and_resume(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1,)]], "n int")
    for wanted in ([1], [1, 2]):
        query = jobs.run_every(stream, f"{tmp_path}/cp", jobs.append_batches(f"{tmp_path}/out"), seconds=1)
        query.processAllAvailable()
        assert query.id in jobs.pause_all(spark) and not query.isActive
        assert column(spark.read.parquet(f"{tmp_path}/out"), "n") == wanted
        spark.createDataFrame([(2,)], "n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_since_keeps_an_overlap(spark):
    rows = spark.createDataFrame([(i, i * 500) for i in range(6)], "n int, ms long").withColumn("at", F.timestamp_millis("ms"))
    assert column(jobs.since(rows, "at", 2000), "n") == [2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(1, "a"), (2, "a"), (3, None)]])
def test_zero_filled(spark, rows):
    row = reports.zero_filled(spark.createDataFrame(rows, "id int, s string"), F.col("s"), ["a", "b"]).first()
    assert (row["a"], row["b"]) == (len([r for r in rows if r[1] == "a"]), 0)


def test_queue_fingerprint_and_names(spark):
    rows = spark.createDataFrame([(1, "a.txt"), (2, "a.txt"), (3, "b")], "id long, name string")
    assert {r["id"]: r["unique_name"] for r in reconcile.sequence_of_names(rows).collect()} == {1: "a.txt", 2: "a (2).txt", 3: "b"}
    assert set(queueing.ACTIVE) == {"queued", "running"}


# --- decisions, links and gaps of notes


def test_final_decision_and_labels(spark):
    rows = [
        (1, "/a", "pdf", "bank", "letter", 0.9, "letter", "bank"),
        (2, "/a", "pdf", None, None, 0.0, None, None),
        (3, "/a", "pdf", None, "letter", 0.9, None, None),
        (4, "/a", "pdf", None, "letter", None, None, None),
        (5, "/Messages/x", "pdf", None, "unknown", 0.95, None, None),
        (6, "/a", "pdf", None, "click", 0.95, "click", None),
        (7, "/a", "docx", None, "click", 0.95, "click", None),
        (8, "/a", None, None, "click", 0.95, "view", None),
    ]
    c, markers = F.col, ["/messages/"]
    d = spark.createDataFrame(rows, "id long, path string, parser string, reviewed string, h string, hc double, m string, x string")
    live = labels.live_decision(c("h"), c("hc"), c("m"), F.lit(0.9), F.lit(0.1), F.lit(0.1))
    d = d.withColumn("live", live).withColumn("d", labels.final_decision(c("path"), c("parser"), c("reviewed"), c("h"), c("hc"), c("m"), c("live"), forced=["pdf|click"], markers=markers))
    got = {r["id"]: (r["d"]["decision_reason"], r["d"]["use_inline_llm"], r["d"]["selected_primary_hint"]) for r in d.collect()}
    assert got == {
        1: ("exact-source-reviewed-feedback", False, "bank"),
        2: ("no-heuristic-fast-path", True, "unknown"),
        3: ("heuristic-without-lightgbm", False, "letter"),
        4: ("review-bound-inline-llm", True, "letter"),
        5: ("heuristic-without-lightgbm", False, "unknown"),
        6: ("forced-inline-from-disagreement-config", True, "click"),
        7: ("fast-path-aligned", False, "click"),
        8: ("model-required", True, "view"),
    }
    named = lambda label, *more: F.struct(label.alias("primary"), F.array(*map(F.lit, more)).cast("array<string>").alias("secondary"))
    last = labels.decided_labels(c("d"), c("path"), named(c("reviewed"), "bank", "", "tax", "tax"), named(c("h"), "photo", "text-message"), named(F.lit("note")), markers)
    kept = {r["id"]: (r["l"]["primary"], r["l"]["secondary"]) for r in d.select("id", last.alias("l")).collect()}
    assert kept == {1: ("bank", ["tax"]), 2: ("note", []), 3: ("letter", ["photo", "text-message"]), 4: ("note", []), 5: ("text-message", ["photo"]), 6: ("note", []), 7: ("click", ["photo", "text-message"]), 8: ("note", [])}


def test_canonical_source_links(spark):
    def link(path, base="https://box/s/"):
        return value(spark, status.canonical_source_link(F.lit(path), F.lit("a]b"), root="/srv/", base=base))

    assert link(None) == link(" ") == ""
    assert link("/srv/x y/z.pdf") == r"[a\]b](<https://box/s/x y/z.pdf>)"
    assert link(r"\srv\x\z.pdf", r" \\box\s\ ") == r"[a\]b](<\\box\s\x\z.pdf>)"
    assert link("/srv/x/z.pdf", "V:/s/") == r"[a\]b](<V:/s\x\z.pdf>)"
    assert [link(p) for p in ("/etc/z", r"C:\x\z", "x/z")] == [r"[a\]b](<file:///etc/z>)", r"[a\]b](<file:///C:/x/z>)", r"[a\]b](<file://x/z>)"]


def test_context_gaps_of_notes(spark):
    files = spark.createDataFrame([(1, "/a", False), (2, "/a", True), (3, "/b", True), (4, None, False), (5, "/c", False)], "id long, path string, is_deleted boolean")
    states = spark.createDataFrame([(1, "queued"), (2, "completed"), (3, "failed"), (5, None)], "file_id long, submission_status string")
    notes = spark.createDataFrame([("p", "h", "s", None), (None, "h", "s", "/m/a"), ("p", " ", "s", "\\m\\b"), ("", "", "", "/m/c"), ("p", "h", None, None), (None, "h", "s", "/mm/a")], "source_parser string, heuristic_primary_hint string, hybrid_live_source string, canonical_source_path string")
    got = reports.note_context_gaps(notes, files, states, root="/m").first()
    assert list(got) == [6, 5, 3, 2, 2, 1, 0, 1, 3, 2, 3]
    assert list(reports.note_context_gaps(notes.limit(0), files, states.limit(0), root="/m").first()) == [0] * 11
