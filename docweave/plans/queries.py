"""The query catalogue: each query with, where SQL can say it, its DuckDB equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions import paths, text
from docweave.operators import boosting, changesets, dataset, dedupe, feedback, labels, queueing, reconcile, reports, retrieval, search, status, taxonomy, training, vectors
from docweave.plans import bindings as b
from docweave.plans.bindings import with_tables
from docweave.sources import messages, readers
from docweave.sources.readers import table
from docweave.sources.shared import shared_dir
from docweave.sources.tables import VersionedTable
from docweave.streaming.dedupe_job import DedupeJob

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- search


def _contains(field: str, word: str) -> str:
    return f"contains(lower(coalesce({field}, '')), '{word}')"


def _search_sql(q: str, limit: int, scope: str | None = None, columns: str = "id, path, score") -> str:
    words = [q.lower(), *search.tokens(q)]
    hit = " or ".join(_contains(f, q.lower()) for f in [*search.WEIGHTS, "retrieval_terms_json"])
    score = " + ".join(
        f"case when {_contains(f, q.lower())} then {full} else 0 end" + "".join(f" + case when {_contains(f, t)} then {each} else 0 end" for t in search.tokens(q)) for f, (full, each) in search.WEIGHTS.items()
    )
    in_terms = " or ".join(f"contains(lower(x), '{w}')" for w in words)
    terms = f"{search.TERM_POINTS} * coalesce(len(list_filter(cast(json_extract_string(retrieval_terms_json, '$[*]') as varchar[]), lambda x: {in_terms})), 0)"
    reason = ", ".join("case when " + " or ".join(_contains(f, w) for w in words) + f" then '{r}' end" for f, r in search.REASONS.items())
    within = f"and (path = '{scope}' or starts_with(path, '{scope}/'))" if scope else ""
    return with_tables(
        f"""
        , rows as (
            select f.id, name, path, mime_type, content_text, s.* exclude (file_id) from files f left join contents c on c.file_id = f.id left join states s on s.file_id = f.id
            where not is_deleted {within}
        ), first as (select * from rows where {hit} order by id limit {max(8 * limit, 40)}),
        ranked as (
            select *, {score} + {terms} as score, list_filter([{reason}], lambda r: r is not null)[1:4] as match_reasons, substr(coalesce(content_text, ''), 1, 280) as excerpt
            from first where not regexp_matches(path, '(^|/)_')
        ) select {columns} from ranked order by score desc, id limit {limit}
        """,
        "files",
        "contents",
        "states",
    ).replace(")\n\n        , rows", "), rows")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return b.files(spark, sf_dir), b.contents(spark, sf_dir), b.states(spark, sf_dir)


@query(_search_sql("the", 10, columns="id, path, score, excerpt"))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_tables(spark, sf_dir), "the", limit=10).select("id", "path", "score", "excerpt")


@query(_search_sql("de la", 5, "/src3/es"))
def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_tables(spark, sf_dir), "de la", limit=5, path_scope="src3/es/").select("id", "path", "score")


@query(_search_sql("license", 12, columns="id, score, array_to_string(match_reasons, ',') as reasons"))
def search_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_tables(spark, sf_dir), "license", limit=12).select("id", "score", F.array_join("match_reasons", ",").alias("reasons"))


@query(_search_sql("report", 50, columns="id, score"))
def search_terms_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_tables(spark, sf_dir), "report", limit=50).select("id", "score")


@query(f"select * from ({_search_sql('und', 20)}) where starts_with(path, '/src12/')")
def search_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.within_namespace(search.search(*_tables(spark, sf_dir), "und", limit=20).select("id", "path", "score"), "src12")


@query(with_tables("select id, length(content_text) as content_chars, length(content_text) > 2000 as truncated, substr(content_text, 1, 2000) as content_text from files join contents on file_id = id where not is_deleted and not regexp_matches(path, '(^|/)_') and id in (1, 2, 3, 53, 97, 120)", "files", "contents"))
def file_details_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_details(b.files(spark, sf_dir), b.contents(spark, sf_dir), [1, 2, 3, 53, 97, 120], most=2000).select("id", "content_chars", "truncated", "content_text")


@query(f"select t.id, path, score, substr(html, 1, 500) as note_text from ({_search_sql('the', 10)}) t join pages on page_id = t.id where t.id in (select id from ({_search_sql('the', 10)}) order by score desc, id limit 5)")
def search_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_bundles(*_tables(spark, sf_dir), b.notes(spark, sf_dir), "the", limit=10, hydrate=5, note_chars=500)


# --- counts and reports


@query(with_tables("select split_part(ltrim(path, '/'), '/', 1) as provider, count(*) as n from files where not is_deleted group by 1", "files"))
def provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.provider_counts(b.files(spark, sf_dir))


@query(with_tables("select status as key, count(*) as n from jobs group by 1", "jobs"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by(b.jobs(spark, sf_dir), F.col("status"))


@query(with_tables("select cast(json_group_object(k, n) as varchar) as json from (select status as k, count(*) as n from jobs group by 1 order by 1)", "jobs"))
def status_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_object(reports.counts_by(b.jobs(spark, sf_dir), F.col("status")), F.col("key"), F.col("n"))


@query(with_tables("select 'total' as metric, count(*) as n from files union all select 'deleted', count(*) from files where is_deleted union all select 'type:' || extension, count(*) filter (where not is_deleted) from files group by extension", "files"))
def mixed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mixed_counters(b.files(spark, sf_dir), F.col("is_deleted"), F.col("extension"))


@query(
    with_tables(
        """select count(*) as total, count(*) filter (where s.file_id is null) as without_state, count(*) filter (where submission_status = 'failed') as failed,
        count(*) filter (where submission_status = 'completed' and confidence < 0.7) as completed_unsure, count(*) filter (where submission_status = 'completed' and confidence >= 0.7) as completed_sure
        from files f left join states s on s.file_id = f.id where not is_deleted""",
        "files",
        "states",
    )
)
def context_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).where(~F.col("is_deleted")).join(b.states(spark, sf_dir), F.col("id") == F.col("file_id"), "left")
    done = F.col("submission_status") == "completed"
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("file_id").isNull()).alias("without_state"),
        F.count_if(F.col("submission_status") == "failed").alias("failed"),
        F.count_if(done & (F.col("confidence") < 0.7)).alias("completed_unsure"),
        F.count_if(done & (F.col("confidence") >= 0.7)).alias("completed_sure"),
    )


@query("select count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as \"view\", count(*) filter (where event_type = 'refund') as refund from events")
def histogram_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.zero_filled(table(spark, sf_dir, "events"), F.col("event_type"), ["click", "view", "refund"])


@query("select user_id, to_json(list({'ts': strftime(ts, '%Y-%m-%d %H:%M:%S'), 'type': event_type} order by ts, event_id)) as events from events group by user_id")
def ordered_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("type"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").alias("k"), "event_id", item.alias("v")))).alias("l"))
    return rows.select("user_id", F.to_json(F.transform("l", lambda x: x["v"])).alias("events"))


@query("select lang as key, count(*) as n from documents group by lang order by n desc, min(doc_id) limit 3")
def most_common_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), 3)


@query("select source, lang, n, place from (select source, lang, count(*) as n, row_number() over (partition by source order by count(*) desc, lang) as place from documents group by source, lang) where place <= 2")
def cooccurrence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.co_occurrence(table(spark, sf_dir, "documents"), "source", "lang", 2)


@query(with_tables("select 'extension' as metric, extension as key, count(*) as n from files group by extension union all select 'mime', mime_type, count(*) from files group by mime_type union all select 'deleted', cast(is_deleted as varchar), count(*) from files group by is_deleted", "files"))
def report_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_report(b.files(spark, sf_dir), {"extension": F.col("extension"), "mime": F.col("mime_type"), "deleted": F.col("is_deleted")})


@query(
    with_tables(
        """, r as (select f.id, extension, primary_label, quality_ok, agrees from (select id, extension from files) f join (select file_id, primary_label, confidence > 0.5 as quality_ok, confidence > 0.5 and file_id % 4 <> 0 as agrees from states) s on s.file_id = f.id),
        a as (select count(*) as samples, count(distinct id) as files, count(distinct extension) as extensions, count(distinct primary_label) as labels, count(*) filter (where quality_ok) as approved, count(*) filter (where agrees) as agreeing from r)
        select *, round(approved / samples, 6) as approval_rate, round(agreeing / approved, 6) as agreement_rate, labels >= 5 and samples >= 10 and round(approved / samples, 6) >= 0.7 as ready from a""",
        "files",
        "states",
    ).replace(")\n, r as", "), r as")
)
def readiness_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.states(spark, sf_dir), F.col("id") == F.col("file_id"))
    good = F.col("confidence") > 0.5
    shaped = rows.select(F.col("id").alias("file"), "extension", F.col("primary_label").alias("label"), good.alias("approved"), (good & (F.col("id") % 4 != 0)).alias("agrees"))
    return reports.readiness(shaped, {"samples": 10, "labels": 5, "approval_rate": 0.7}).drop("warnings")


@query("select lang, list_sort(list(distinct source)) as sources, count(distinct source) as n from documents group by lang")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.countDistinct("source").alias("n"))


@query("select concat_ws('|', event_type, cast(user_id % 3 as varchar)) as pair, count(*) as n from events where value > 50 or event_type = 'error' group by 1 having count(*) >= 20")
def pair_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("first"), (F.col("user_id") % 3).cast("string").alias("second"), "value")
    return reports.pair_disagreements([e.where("value > 50"), e.where("value <= 50 and first = 'error'")], 20)


@query("select user_id, count(*) filter (where event_type = 'click') as click_count, list_sort(coalesce(list(event_id) filter (where event_type = 'click'), [])) as click_items from events group by user_id")
def bucketed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bucketed(table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id"), ["click"], by=["user_id"])


@query("with r as (select source as remote, count(*) % 2 = 0 as required, min(doc_id) % 3 <> 0 as ok from documents group by source) select list_sort(list(remote) filter (where not ok)) as degraded, list_sort(coalesce(list(remote) filter (where not ok and required), [])) as required_failures, case when count(*) filter (where not ok and required) > 0 then 'failed' when count(*) filter (where not ok) > 0 then 'degraded' else 'ok' end as status from r")
def remote_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("remote")).agg((F.count(F.lit(1)) % 2 == 0).alias("required"), (F.min("doc_id") % 3 != 0).alias("ok"))
    return reports.rollup_status(r)


# --- joins


@query(with_tables("select f.id, length(content_text) as chars, submission_status, primary_label from files f left join contents c on c.file_id = f.id left join states s on s.file_id = f.id where not is_deleted", "files", "contents", "states"))
def left_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.index_rows(*_tables(spark, sf_dir)).where(~F.col("is_deleted"))
    return rows.select("id", F.length("content_text").cast("long").alias("chars"), "submission_status", "primary_label")


@query(with_tables("select path, submission_status from files join states on file_id = id where submission_status in ('failed', 'queued')", "files", "states"))
def inner_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).join(b.states(spark, sf_dir).where(F.col("submission_status").isin("failed", "queued")), F.col("id") == F.col("file_id")).select("path", "submission_status")


@query(with_tables("select id, path from files f where not exists (select 1 from jobs j where j.file_id = f.id and status in ('queued', 'running'))", "files", "jobs"))
def anti_join_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = b.jobs(spark, sf_dir).where(F.col("status").isin(queueing.ACTIVE)).select("file_id")
    return b.files(spark, sf_dir).join(active, F.col("id") == F.col("file_id"), "left_anti").select("id", "path")


@query(with_tables("select id from files f where id in (select file_id from jobs where status = 'failed')", "files", "jobs"))
def semi_join_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).join(b.jobs(spark, sf_dir).where("status = 'failed'").select("file_id"), F.col("id") == F.col("file_id"), "left_semi").select("id")


@query(with_tables("select path, list_sort(list(status)) as statuses from files join jobs on file_id = files.id group by path", "files", "jobs"))
def path_status_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.jobs(spark, sf_dir).groupBy("file_id").agg(F.sort_array(F.collect_list("status")).alias("statuses"))
    return b.files(spark, sf_dir).join(j, F.col("id") == F.col("file_id")).select("path", "statuses")


_MATCH = """with l as (select doc_id as lid, sha256(text) as hash, concat(source, '-', n_chars) as name, doc_id % 40 as bucket from documents where doc_id % 2 = 0),
 r as (select doc_id as rid, sha256(text) as hash, concat(source, '-', n_chars) as name, doc_id % 40 as bucket from documents where doc_id % 2 = 1)"""


def _match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.concat_ws("-", "source", "n_chars").alias("name"), (F.col("doc_id") % 40).alias("bucket"))
    return d.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "lid"), d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "rid")


@query(_MATCH + ", m as (select lid, rid, 0 as rank from l join r using (hash) union all select lid, rid, 1 from l join r using (name)), p as (select lid, rid, min(rank) as rank from m group by lid, rid) select lid, rid, rank from p where rank = (select min(rank) from p q where q.lid = p.lid)")
def cascading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.cascading_match(*_match_sides(spark, sf_dir), ["hash", "name"])


@query(
    _MATCH
    + """, h as (select hash, count(*) as n, min(rid) as rid from r group by hash), n as (select name, count(*) as n, min(rid) as rid from r group by name), k as (select bucket, count(*) as n, min(rid) as rid from r group by bucket)
    select lid, case when h.n = 1 or (h.n is null and n.n = 1) or (h.n is null and n.n is null and k.n = 1) then 'repair' when coalesce(h.n, n.n, k.n) > 1 then 'ambiguous' else 'missing' end as status,
    case when h.n = 1 then h.rid when h.n > 1 then null when n.n = 1 then n.rid when n.n > 1 then null when k.n = 1 then k.rid end as rid
    from l left join h on h.hash = l.hash left join n on n.name = l.name left join k on k.bucket = l.bucket"""
)
def unique_or_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.unique_or_ambiguous(*_match_sides(spark, sf_dir), ["hash", "name", "bucket"])


@query(
    with_tables(
        """, o as (select event_id as seq, case when event_id % 2 = 0 then concat('/src', user_id % 20, '/en/Document ', user_id, '.txt') end as path, concat('Document ', user_id, '.txt') as name, event_type as label from events)
        select f.id, coalesce(p.label, n.label) as label from files f left join (select path, arg_max(label, seq) as label from o where path is not null group by path) p on p.path = f.path left join (select name, arg_max(label, seq) as label from o group by name) n on n.name = f.name""",
        "files",
    ).replace(")\n, o as", "), o as")
)
def latest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("Document "), "user_id", F.lit(".txt"))
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/src"), F.col("user_id") % 20, F.lit("/en/"), name))
    return reconcile.latest_override(b.files(spark, sf_dir), e.select(F.col("event_id").alias("seq"), path.alias("path"), name.alias("name"), F.col("event_type").alias("label")))


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"with d as (select doc_id as id, unnest({_WORDS}) as w from documents), e as (select item_id as eid, unnest({_WORDS}) as w from benchmark) select * from (select id, eid, count(*) as n, row_number() over (partition by id order by count(*) desc, eid) as place from d join e using (w) group by id, eid) where place <= 3")
def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words)
    return taxonomy.similar_examples(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eid"), words))


_ALIASES = [("report", "the"), ("report", "of the"), ("letter", "de la"), ("letter", "und"), ("legal", "license"), ("legal", "to the"), ("note", "en el")]


@query(
    "with a as (select * from (values "
    + ", ".join(f"('{x}', '{y}')" for x, y in _ALIASES)
    + """) t(label, alias)), d as (select doc_id as id, ' ' || trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' as p from documents),
    h as (select id, label, alias, 2 + least(len(string_split(alias, ' ')), 3) as points from d join a on contains(p, ' ' || alias || ' ')),
    s as (select id, label, sum(points)::bigint as score, list_sort(list(distinct alias))[1:4] as evidence from h group by id, label)
    select * from (select *, row_number() over (partition by id order by score desc, label) as place from s) where place <= 6"""
)
def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(_ALIASES, "local string, alias string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content_text"))
    return taxonomy.match_aliases(docs, aliases)


_ROUTES = {"english": ["the", "and", "thing"], "french": ["leaux", "de la", "ouai"], "german": ["ung", "heit", "der"], "legal": ["license", "copyright"]}


def _rule_score(words: list[str]) -> str:
    return " + ".join(f"case when contains(lower(text), '{w}') then {2 if len(w) > 4 else 1} else 0 end" for w in words)


@query("with s as (" + " union all ".join(f"select doc_id, '{k}' as label, {_rule_score(w)} as score, " + " + ".join(f"contains(lower(text), '{x}')::int" for x in w) + " as n from documents" for k, w in _ROUTES.items()) + ") select doc_id, arg_max(label, (score, n, label)) as label, max(score) as score from s group by doc_id")
def keyword_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = labels.ranked_labels(F.col("text"), F.lit("bin"), F.lit("none"), _ROUTES)
    return table(spark, sf_dir, "documents").select("doc_id", ranked[0].alias("r")).select("doc_id", "r.label", "r.score")


@query(with_tables("select r.p as relative_path, coalesce(a.id, c.id) as id from (select distinct regexp_replace(path, '^/[^/]*/', '') as p from files) r left join files a on a.path = '/src1/' || r.p left join files c on c.path = '/src2/' || r.p", "files"))
def first_of_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.files(spark, sf_dir)
    return reconcile.first_of_namespaces(f.select(paths.relative_path(F.col("path")).alias("relative_path")).distinct(), f, ["src1", "src2"])


# --- duplicates

_GROUP_KEY = {
    "content_hash": "content_hash || ':' || coalesce(size_bytes, 0)",
    "normalized_name_size": "nullif(trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')), '') || ':' || coalesce(size_bytes, 0)",
}


def _dedupe_sql(strategies: list[str], most: int, tail: str, where: str = "true", name: str = "name") -> str:
    each = " union all ".join(f"select id, path, size_bytes, modified_at, '{s}' as strategy, sha256('{s}|' || {_GROUP_KEY[s]}) as fingerprint from base where {_GROUP_KEY[s]} is not null" for s in strategies)
    conf = "case strategy " + " ".join(f"when '{s}' then {c}" for s, c in dedupe.CONFIDENCE.items()) + " end"
    return with_tables(
        f""", base as (select f.* replace ({name} as name), content_hash from files f left join contents c on c.file_id = f.id where not is_deleted and {where} and not regexp_matches(path, '(^|/)_')),
        rows as ({each}), numbered as (select *, row_number() over (partition by strategy, fingerprint order by id) as m from rows),
        seconds as (select id from numbered where m = 2 order by id, strategy, fingerprint limit {most}), cut as (select case when count(*) < {most} then 9223372036854775807 else max(id) end as c from seconds),
        kept as (select * from rows where id <= (select c from cut)),
        ranked as (select *, row_number() over (partition by strategy, fingerprint order by epoch(modified_at) desc, length(path), lower(path), id) as place from kept),
        found as (select strategy, fingerprint, count(*) - 1 as duplicate_count, sum(size_bytes)::bigint as total_size_bytes, min(id) filter (where place = 1) as keep_id, {conf} as confidence from ranked group by strategy, fingerprint having count(*) > 1)
        {tail}""",
        "files",
        "contents",
    ).replace(")\n, base", "), base")


#: For the early stop: as many groups as there are.
_ALL = 1 << 62
_FOUND = "select strategy, fingerprint, duplicate_count, total_size_bytes, keep_id, confidence from found"
_FOUND_COLS = ["strategy", "fingerprint", "duplicate_count", "total_size_bytes", "keep_id", "confidence"]


@query(_dedupe_sql(["content_hash"], _ALL, _FOUND))
def dedupe_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.run_all(b.files(spark, sf_dir), b.contents(spark, sf_dir), strategies=["content_hash"]).select(*_FOUND_COLS)


@query(_dedupe_sql(["normalized_name_size"], _ALL, _FOUND, name="case when id % 2 = 0 then 'Report-' || extension || '.txt' else 'report ' || extension || '.TXT' end"))
def dedupe_name_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Report-"), "extension", F.lit(".txt"))).otherwise(F.concat(F.lit("report "), "extension", F.lit(".TXT")))
    return dedupe.run_all(b.files(spark, sf_dir).withColumn("name", name), b.contents(spark, sf_dir), strategies=["normalized_name_size"]).select(*_FOUND_COLS)


@query(_dedupe_sql(["content_hash", "normalized_name_size"], _ALL, _FOUND, "(path like '/src1/%' or path like '/src2/%' or path like '/src3/%')"))
def dedupe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.run_all(b.files(spark, sf_dir), b.contents(spark, sf_dir), strategies=["content_hash", "normalized_name_size"], namespaces=["src1", "src2", "src3"]).select(*_FOUND_COLS)


@query(_dedupe_sql(["content_hash"], 5, _FOUND))
def dedupe_max_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.run(b.files(spark, sf_dir), b.contents(spark, sf_dir), strategies=["content_hash"], max_groups=5).select(*_FOUND_COLS)


@query(_dedupe_sql(["content_hash", "normalized_name_size"], _ALL, _FOUND))
def dedupe_job_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunked job over all files, advanced to its end in steps of two fifths of them."""
    files = b.files(spark, sf_dir)
    folder = f"{shared_dir(spark)}/dedupe-job-{uuid.uuid4().hex}"
    job = DedupeJob.create(files, b.contents(spark, sf_dir), folder, strategies=["content_hash", "normalized_name_size"], chunk_size=2 * files.count() // 5 + 1, max_groups=None)
    while job.advance()["status"] != "complete":
        pass
    return job.found().select(*_FOUND_COLS)


@query(_dedupe_sql(["content_hash"], _ALL, "select k.id, k.path, case when k.id = f.keep_id then 'canonical' else 'duplicate' end as role, case when k.id = f.keep_id then 'keep' else 'move_to_backup' end as action from kept k join found f on f.fingerprint = k.fingerprint"))
def dedupe_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.fingerprints(dedupe.candidates(b.files(spark, sf_dir)), b.contents(spark, sf_dir), ["content_hash"])
    return dedupe.members(rows, dedupe.groups(rows)).select("id", "path", "role", "action")


@query(_dedupe_sql(["content_hash"], _ALL, "select substr(sha256('job|' || strategy || '|' || fingerprint), 1, 24) as group_id, duplicate_count, total_size_bytes from found where duplicate_count >= 1 order by total_size_bytes desc, group_id limit 10 offset 5"))
def dedupe_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe.run_all(b.files(spark, sf_dir), b.contents(spark, sf_dir), strategies=["content_hash"])
    return dedupe.list_groups(found, offset=5, limit=10).select("group_id", "duplicate_count", "total_size_bytes")


@query(with_tables("select * from (select content_hash || ':' || size_bytes as fingerprint, count(*) as members, arg_min(id, (lower(path), id)) as canonical_id from files join contents on file_id = id where not is_deleted group by 1 order by 1 limit 200) where members > 1", "files", "contents"))
def dedupe_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.legacy_groups(b.files(spark, sf_dir), b.contents(spark, sf_dir), 200)


# --- windows, order, sets


@query(with_tables("select id, file_id, row_number() over (partition by file_id order by case when status = 'running' then 0 else 1 end, id) as n from jobs qualify n = 1", "jobs"))
def row_number_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy(F.when(F.col("status") == "running", 0).otherwise(1), "id")
    return b.jobs(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "file_id", "n")


@query("select doc_id as id, source, row_number() over (partition by source order by doc_id) as turn from documents")
def round_robin_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.round_robin(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "source")


@query(with_tables("select file_id as id, primary_label from states qualify row_number() over (partition by primary_label order by file_id) <= 15", "states"))
def label_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.label_quota(b.states(spark, sf_dir).select(F.col("file_id").alias("id"), "primary_label"), "primary_label", 15)


@query("select source, doc_id as second_id from documents qualify row_number() over (partition by source order by doc_id) = 2")
def second_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("m", F.row_number().over(order)).where("m = 2").select("source", F.col("doc_id").alias("second_id"))


@query("select doc_id as id from documents where doc_id > 100 order by doc_id limit 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.progress_step(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 100, 40)


@query("select event_id, priority from (select event_id, value as priority from events) order by priority desc, event_id limit 20 offset 10")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("value").alias("priority")).orderBy(F.desc("priority"), "event_id").offset(10).limit(20)


@query("select event_id, event_type from events order by event_id desc limit 7")
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(7)


@query("select event_type, max(ts) as last_ts, arg_max(event_id, (ts, event_id)) as last_id from events group by event_type")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@query(with_tables("select 'state' as feedback_source, file_id, primary_label as correct_label, null as old_label from states union all select 'event', user_id, event_type, 'view' from events where event_type <> 'view'", "states"))
def feedback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.states(spark, sf_dir).select("file_id", F.col("primary_label").alias("correct_label"), F.lit(None).cast("string").alias("old_label"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("correct_label"), F.lit("view").alias("old_label"))
    return training.feedback_rows({"state": s, "event": e}).select("feedback_source", "file_id", "correct_label", "old_label")


@query(
    """with w as (select doc_id, w, i from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) as i from documents)),
    f as (select doc_id, arg_min(w, i) as w, min(i) as i from w group by doc_id, lower(w)) select doc_id, string_agg(w, ' ' order by i) as words from f group by doc_id"""
)
def ordered_distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.distinct_ignoring_case(words), " ").alias("words")).where("words <> ''")


_CANON = " ".join(f"when lower(trim(label)) in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in text.CANONICAL_LABELS.items())


_KNOWN = sorted(x for v in text.CANONICAL_LABELS.values() for x in v)
_RAW_LABEL = f"case event_id % 3 when 0 then concat(' ', upper(event_type)) when 1 then element_at(array({', '.join(repr(x) for x in _KNOWN)}), cast(event_id % {len(_KNOWN)} + 1 as int)) end"


@query(
    f"""with l as (select {_RAW_LABEL.replace("element_at(array(", "list_extract(list_value(")} as label from events)
    select label, case when trim(coalesce(label, '')) = '' then 'unknown' {_CANON} else lower(trim(label)) end as canonical, count(*) as n from l group by all"""
)
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels of all events (types in upper case, other names of labels, none) with what they stand for."""
    raw = spark.sql(f"select {_RAW_LABEL} as label from {{t}}", t=table(spark, sf_dir, "events"))
    return raw.select("label", text.canonical_label(F.col("label")).alias("canonical")).groupBy("label", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query("select a.source, list_sort(list_intersect(a.l, b.l)) as both_langs, list_sort(list_filter(a.l, lambda x: not list_contains(b.l, x))) as only_first from (select source, list(distinct lang) as l from documents where n_chars % 2 = 0 group by source) a join (select source, list(distinct lang) as l from documents where n_chars % 2 = 1 group by source) b on a.source = b.source")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    even = d.where("n_chars % 2 = 0").groupBy("source").agg(F.collect_set("lang").alias("a"))
    odd = d.where("n_chars % 2 = 1").groupBy("source").agg(F.collect_set("lang").alias("b"))
    return even.join(odd, "source").select("source", F.sort_array(F.array_intersect("a", "b")).alias("both_langs"), F.sort_array(F.array_except("a", "b")).alias("only_first"))


@query("select name as old_name, n_name as unique_name from (select doc_id, concat(lang, '.txt') as name, case when row_number() over (partition by lang order by doc_id) > 1 then concat(lang, ' (', row_number() over (partition by lang order by doc_id), ').txt') else concat(lang, '.txt') end as n_name from documents)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit(".txt")).alias("name"))
    return reconcile.sequence_of_names(rows).join(rows, "id").select(F.col("name").alias("old_name"), "unique_name")


_NAMES = "case when doc_id % 7 = 0 then concat(lang, ' (', 2 + doc_id % 40, ').txt') else concat(lang, '.txt') end"


@query(
    f"""with rows as (select doc_id as id, {_NAMES} as name from documents), existing as (select 'en.txt' as name union all select 'fr (3).txt' union all select 'de (2).txt'),
    known as (select name from rows union select name from existing),
    owners as (select name, min(id) as id from rows where name not in (select name from existing) group by name),
    asks as (select id, name, row_number() over (partition by name order by id) as r from rows where id not in (select id from owners)),
    taken as (select concat(regexp_extract(name, '^(.*) \\((\\d+)\\)(\\.txt)$', 1), '.txt') as name, regexp_extract(name, '^(.*) \\((\\d+)\\)(\\.txt)$', 2)::int as t from known where name like '% (%).txt'),
    gaps as (select name, t - row_number() over (partition by name order by t) as r from taken),
    counted as (select a.id, a.name, a.r, count(g.r) as before from asks a left join gaps g on g.name = a.name and g.r <= a.r group by a.id, a.name, a.r),
    numbers as (select id, name, r + 1 + before as n from counted)
    select id, name as unique_name from owners union all select id, concat(name[:-5], ' (', n, ').txt') from numbers"""
)
def unique_names_against_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"select doc_id as id, {_NAMES} as name from {{t}}", t=table(spark, sf_dir, "documents"))
    existing = spark.createDataFrame([("en.txt",), ("fr (3).txt",), ("de (2).txt",)], "name string")
    return reconcile.sequence_of_names(rows, existing)


@query(with_tables("select id, path, case when id % 7 = 0 then size_bytes + 1 else size_bytes end as size_bytes from files union all select id + 1000000000, path, size_bytes from files where id % 11 = 0", "files"))
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as a first version, then changed and added ones as a second."""
    files = b.files(spark, sf_dir).select("id", "path", "size_bytes")
    held = VersionedTable(spark, f"{shared_dir(spark)}/files-{uuid.uuid4().hex}", "id", 16, "id long, path string, size_bytes long")
    held.upsert(files, batch="snapshot")
    changed = files.where("id % 7 = 0").withColumn("size_bytes", F.col("size_bytes") + 1)
    held.upsert(changed.union(files.where("id % 11 = 0").withColumn("id", F.col("id") + 1_000_000_000)), batch="changes")
    return held.read()


#: Each user's file is moved and deleted by the user's events; some paths are taken again after their file was deleted.
_LOG = """with steps as (
        select event_id as id, user_id, event_type, concat('cs', event_id % 7) as change_set, row_number() over (partition by user_id order by event_id) as k,
               case when event_type in ('purchase', 'signup') then concat('/_backup/', event_id) else concat('/live/', user_id, '/', event_id) end as target,
               case when event_type in ('purchase', 'signup') then 'delete' else 'move' end as op
        from {events}
    ), moves as (
        select id, user_id, change_set, op, coalesce(lag(target) over (partition by user_id order by id), concat('/live/', user_id)) as path, target,
               k = max(k) over (partition by user_id) as is_last from steps
    )"""


@query(
    _LOG.format(events="events")
    + """, made as (select id + 1000000000 as born, path from moves where is_last and op = 'delete' and user_id % 3 = 0)
    select user_id as file, null::bigint as born, case when change_set in ('cs1', 'cs2', 'cs3') and m.path not in (select path from made) then path else target end as path,
           case when change_set in ('cs1', 'cs2', 'cs3') then case when m.path in (select path from made) then 'conflict' else 'restored' end when op = 'delete' then 'deleted' else 'live' end as state
    from moves m where is_last union all select null, born, path, 'live' from made"""
)
def restored_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    moves = spark.sql(_LOG.format(events="{t}") + " select * from moves", t=events)
    made = moves.where("is_last and op = 'delete' and user_id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "change_set", F.lit("create").alias("op"), F.lit(None).cast("string").alias("path"), F.col("path").alias("target"))
    files = events.select(F.col("user_id").alias("file"), F.concat(F.lit("/live/"), "user_id").alias("path")).distinct()
    wanted = spark.createDataFrame([("cs1",), ("cs2",), ("cs3",)], "change_set string")
    return changesets.restored_tree(files, moves.select("id", "change_set", "op", "path", "target").union(made), wanted)


@query(
    """with m as (select conv_id * 10000 + turn as id, coalesce(text, '') as text, role from conversations)
    select id, '0' as path, 0 as depth, 'multipart/mixed' as mime_type, null as data from m
    union all select id, '0.0', 1, 'multipart/alternative', null from m
    union all select id, '0.0.0', 2, 'text/plain', text from m
    union all select id, '0.0.1', 2, 'text/html', '<p>' || text || '</p>' from m
    union all select id, '0.1', 1, 'text/plain', 'sent by ' || role from m"""
)
def mail_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of messages made from the turns of conversations: a text as plain and HTML, and a footer."""
    encoded = lambda c: F.struct(F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_").alias("data"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    leaf = lambda mime, c: F.struct(F.lit(mime).alias("mimeType"), encoded(c).alias("body"))
    both = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(leaf("text/plain", F.col("text")), leaf("text/html", F.concat(F.lit("<p>"), "text", F.lit("</p>")))).alias("parts"))
    footer = leaf("text/plain", F.concat(F.lit("sent by "), "role"))
    payload = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), F.to_json(both), F.lit(","), F.to_json(footer), F.lit("]}"))
    return messages.message_parts(turns.select("id", payload.alias("payload"))).drop("turn")


# --- scalar functions, retrieval metadata


@query(with_tables("select id, split_part(ltrim(path, '/'), '/', 1) as provider, regexp_replace(ltrim(path, '/'), '^[^/]*/', '') as rel, regexp_matches(path, '(^|/)_') as hidden, 'document ' || id || ' ' || extension as norm, 'document' || id || extension as name_key, extension as ext, case when length(regexp_replace(content_text, '[^\\p{L}\\p{N}]', '', 'g')) >= 120 then 'high' when length(regexp_replace(content_text, '[^\\p{L}\\p{N}]', '', 'g')) >= 20 then 'medium' when length(regexp_replace(content_text, '[^\\p{L}\\p{N}]', '', 'g')) >= 8 then 'low' else 'empty' end as quality from files join contents on file_id = id", "files", "contents"))
def path_and_name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.contents(spark, sf_dir), F.col("id") == F.col("file_id"))
    p, n = F.col("path"), F.col("name")
    return rows.select("id", paths.provider(p).alias("provider"), paths.relative_path(p).alias("rel"), paths.has_hidden_segment(p).alias("hidden"), text.normalized_name(n).alias("norm"), text.name_key(n).alias("name_key"), paths.extension(F.lit(None).cast("string"), n).alias("ext"), text.extraction_quality(F.col("content_text")).alias("quality"))


@query(r"select doc_id, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) as emails, len(regexp_extract_all(text, '\b(?:\+?1[-.\s]*)?(?:\(?\d{3}\)?[-.\s]*)\d{3}[-.\s]*\d{4}\b')) as phones from documents")
def entity_emails_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(retrieval.EMAIL).alias("emails"), count(retrieval.PHONE).alias("phones"))


@query(
    "with t as (select doc_id, trim(unnest(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9._:/#-]{1,63}')), '._/-') as term from documents), c as (select doc_id, term, count(*) as n from t where length(term) >= 3 and term not in ("
    + ", ".join(repr(w) for w in retrieval.STOP_WORDS)
    + ") group by doc_id, term) select * from (select *, row_number() over (partition by doc_id order by n desc, term) as place from c) where place <= 24"
)
def text_terms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.text_terms(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


_TOPIC_CASES = ", ".join("case when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{t}' end" for t, words in retrieval.TOPICS.items())


@query(f"select doc_id, array_to_string(list_filter([{_TOPIC_CASES}], lambda x: x is not null), ',') as topics from documents")
def topics_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.topics(F.lower("text"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("topics"))


@query()
def retrieval_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.index_rows(*_tables(spark, sf_dir)).withColumn("labels", F.array_compact(F.array("primary_label")))
    return retrieval.retrieval_metadata(rows)


# --- queue


@query(with_tables("select f.id, 'text:' || content_hash as fingerprint, case when extension = 'png' then 'text-backed' else 'document' end as bucket from files f join contents c on c.file_id = f.id where not is_deleted and not exists (select 1 from jobs j where j.file_id = f.id and status in ('queued', 'running')) and not exists (select 1 from states s where s.file_id = f.id and submission_status = 'completed' and s.file_id % 2 = 0) and id % 97 <> 0", "files", "contents", "states", "jobs"))
def fingerprint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c, s = _tables(spark, sf_dir)
    current = s.join(c, "file_id").withColumn("source_fingerprint", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("text:"), "content_hash")).otherwise("stale"))
    return queueing.needs_work(f, c, current, b.jobs(spark, sf_dir)).select("id", "fingerprint", "bucket")


@query(with_tables("select id, 'document' as bucket, 0 as rank from files f where not is_deleted and extension in ('pdf', 'csv', 'md', 'txt') and id % 97 <> 0 and not exists (select 1 from jobs j where j.file_id = f.id and status in ('queued', 'running')) order by id limit 30", "files", "jobs"))
def enqueue_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c, s = _tables(spark, sf_dir)
    return queueing.enqueue_plan(f, c, s.withColumn("source_fingerprint", F.lit("stale")), b.jobs(spark, sf_dir), 30).select("id", "bucket", "rank")


@query(with_tables("select id, priority_rank from jobs where status = 'queued' and (next_attempt_at is null or next_attempt_at <= timestamp '2024-01-15') order by priority_rank, id limit 25", "jobs"))
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.claim_next(b.jobs(spark, sf_dir), F.lit("2024-01-15").cast("timestamp"), 25).select("id", "priority_rank")


@query(with_tables("select id, case when status = 'running' and (heartbeat_at is null or heartbeat_at < timestamp '2024-01-10') then 'queued' else status end as status from jobs", "jobs"))
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queueing.recover_stale(b.jobs(spark, sf_dir), F.lit("2024-01-10").cast("timestamp")).select("id", "status")


@query(with_tables("select id, case when file_id % 7 = 0 or id % 4 + 1 >= 3 then 'failed' else 'queued' end as status, id % 4 + 1 as attempts from jobs where status = 'failed'", "jobs"))
def retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = queueing.retry_outcome(F.col("id") % 4, F.lit(3), F.col("file_id") % 7 == 0, F.col("created_at"))
    return b.jobs(spark, sf_dir).where("status = 'failed'").select("id", out.alias("o")).select("id", "o.status", "o.attempts")


@query("select user_id, arg_max(event_type, (ts, event_id)) as label from events group by user_id having arg_max(event_type, (ts, event_id)) <> 'view' order by user_id limit 40")
def requeue_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("label"), F.col("ts").alias("recorded_at"))
    s = e.select("file_id").distinct().select("file_id", F.lit("view").alias("primary_label"), F.lit("2000-01-01").cast("timestamp").alias("completed_at"))
    return queueing.requeue_targets(e, s, 40).select(F.col("file_id").alias("user_id"), "label")


# --- labels, taxonomy, training


@query(
    """with e as (select event_id, event_type as h, case when event_id % 3 = 0 then event_type else 'view' end as m, value / 500.0 as hc, (event_id % 100) / 100.0 as mc, (event_id % 10) / 10.0 as llm, (event_id % 7) / 10.0 as risk from events)
    select event_id, not (h = m and hc >= 0.92 and risk < 0.35 and (mc >= 0.8 or (mc >= 0.6 and llm < 0.45))) as use_inline_llm, case when h = m and hc >= 0.92 and risk < 0.35 and (mc >= 0.8 or (mc >= 0.6 and llm < 0.45)) then h else m end as hint from e"""
)
def gating_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, i = F.col("event_type"), F.col("event_id")
    d = labels.live_decision(h, F.col("value") / 500.0, F.when(i % 3 == 0, h).otherwise("view"), (i % 100) / 100.0, (i % 10) / 10.0, (i % 7) / 10.0)
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d.use_inline_llm", F.col("d.selected_primary_hint").alias("hint"))


_DECIDED = """with e as (select event_id, case when event_id % 50 = 0 then 'purchase' end as reviewed, case when event_id % 13 > 0 then event_type end as h, case when event_id % 11 > 0 then case when event_id % 3 = 0 then event_type else 'view' end end as m,
      value / 500.0 as hc, (event_id % 100) / 100.0 as mc, (event_id % 10) / 10.0 as llm, (event_id % 7) / 10.0 as risk, case event_id % 4 when 0 then 'pdf' when 1 then 'docx' else 'text' end as parser, event_id % 9 = 0 as message from events),
    f as (select *, coalesce(h = m and hc >= 0.92 and risk < 0.35 and (mc >= 0.8 or (mc >= 0.6 and llm < 0.45)), false) as fast from e),
    d as (select *, case when h is null then 'no-heuristic-fast-path' when m is null then 'heuristic-without-lightgbm' when parser || '|' || h in ('pdf|click', 'text|view') then 'forced-inline-from-disagreement-config' when fast then 'fast-path-aligned' else 'model-required' end as first,
      case when h is null then coalesce(m, 'unknown') when m is null then h when fast then h else m end as hint from f),
    r as (select *, case when reviewed is not null then 'exact-source-reviewed-feedback' when first in ('heuristic-without-lightgbm', 'fast-path-aligned') and hc < 0.7 then 'review-bound-inline-llm' else first end as decision_reason from d)
    select event_id, decision_reason, decision_reason not in ('exact-source-reviewed-feedback', 'heuristic-without-lightgbm', 'fast-path-aligned') as use_inline_llm,
      case when reviewed is not null then 'manual-correction-override' when decision_reason in ('heuristic-without-lightgbm', 'fast-path-aligned') then 'heuristic-fast-path' else 'inline-llm' end as live_source, coalesce(reviewed, hint) as hint,
      case when reviewed is not null then reviewed when message then 'text-message' when decision_reason in ('heuristic-without-lightgbm', 'fast-path-aligned') then h else 'letter' end as label,
      case when reviewed is not null then '' when message then case when decision_reason in ('heuristic-without-lightgbm', 'fast-path-aligned') then h else 'letter,note' end when decision_reason in ('heuristic-without-lightgbm', 'fast-path-aligned') then '' else 'note' end as secondary from r"""


@query(_DECIDED)
def final_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    path = F.concat(F.when(i % 9 == 0, "/a/Text Messages/").otherwise("/a/"), i.cast("string"))
    parser = F.when(i % 4 == 0, "pdf").when(i % 4 == 1, "docx").otherwise("text")
    given = {"reviewed": F.when(i % 50 == 0, "purchase"), "h": F.when(i % 13 > 0, kind), "m": F.when(i % 11 > 0, F.when(i % 3 == 0, kind).otherwise("view"))}
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500.0).alias("hc"), path.alias("path"), parser.alias("parser"), *(c.alias(n) for n, c in given.items()))
    live = labels.live_decision(F.col("h"), F.col("hc"), F.col("m"), (i % 100) / 100.0, (i % 10) / 10.0, (i % 7) / 10.0)
    c, markers = F.col, ["/text messages/"]
    rows = rows.withColumn("live", live)
    rows = rows.withColumn("d", labels.final_decision(c("path"), c("parser"), c("reviewed"), c("h"), c("hc"), c("m"), c("live"), forced=["pdf|click", "text|view"], markers=markers))
    named = lambda label, *more: F.struct(label.alias("primary"), F.array(*map(F.lit, more)).cast("array<string>").alias("secondary"))
    found = labels.decided_labels(c("d"), c("path"), named(c("reviewed")), named(c("h")), named(F.lit("letter"), "note"), markers)
    return rows.select("event_id", found.alias("l"), "d").select("event_id", "d.use_inline_llm", "d.live_source", c("d.selected_primary_hint").alias("hint"), "d.decision_reason", c("l.primary").alias("label"), F.array_join("l.secondary", ",").alias("secondary"))


_LINK = "case when starts_with(p, '/srv/store/') then {0} || {1} when regexp_matches(p, '^[A-Za-z]:/') then 'file:///' || p else 'file://' || p end || '>)'"
_BELOW = "substr(p, 12)"


@query(
    with_tables(
        ", l as (select id, replace(trim(case id % 5 when 0 then '/srv/store' || path when 1 then path when 2 then 'C:\\docs\\' || name when 3 then ' share/' || name else '' end), '\\', '/') as p, replace('Note [' || id || ']', ']', '\\]') as n from files) "
        "select id, case when p = '' then '' else '[' || n || '](<' || " + _LINK.format("'\\\\box\\store\\'", f"replace({_BELOW}, '/', '\\')") + " end as share, case when p = '' then '' else '[' || n || '](<' || "
        + _LINK.format("'V:\\store\\'", f"replace({_BELOW}, '/', '\\')") + " end as drive, case when p = '' then '' else '[' || n || '](<' || " + _LINK.format("'https://box/store/'", _BELOW) + " end as url from l",
        "files",
    )
)
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    path = F.when(i % 5 == 0, F.concat(F.lit("/srv/store"), "path")).when(i % 5 == 1, F.col("path")).when(i % 5 == 2, F.concat(F.lit("C:\\docs\\"), "name")).when(i % 5 == 3, F.concat(F.lit(" share/"), "name")).otherwise("")
    name = F.concat(F.lit("Note ["), "id", F.lit("]"))
    bases = {"share": "\\\\box\\store\\", "drive": "V:/store/".replace("/", "\\"), "url": "https://box/store/"}
    return b.files(spark, sf_dir).select("id", *(status.canonical_source_link(path, name, root="/srv/store/", base=base).alias(c) for c, base in bases.items()))


_NOTE_CONTEXT = "case when id % 3 > 0 then 'pdf' end as source_parser, case when id % 4 > 0 then 'letter' else ' ' end as heuristic_primary_hint, case when id % 5 > 0 then 'inline-llm' end as hybrid_live_source, case when id % 19 = 0 then null when id % 17 = 0 then concat('/elsewhere', path) else concat('/mirror', path) end as canonical_source_path"


@query(
    with_tables(
        f""", n as (select {_NOTE_CONTEXT} from files), m as (select source_parser is null as a, heuristic_primary_hint = ' ' as b, hybrid_live_source is null as c, case when starts_with(canonical_source_path, '/mirror/') then substr(canonical_source_path, 8) end as path from n),
        g as (select path, bool_or(not is_deleted) as live, count(submission_status) as k, count(*) filter (where submission_status = 'completed') as d, count(*) filter (where submission_status = 'queued') as q from files f left join states s on s.file_id = f.id group by path),
        j as (select a, b, c, a or b or c as gap, coalesce(live, false) as live, coalesce(k, 0) as k, coalesce(d, 0) as d, coalesce(q, 0) as q from m left join g using (path))
        select count(*) as total_generated_notes, count(*) filter (where gap) as notes_missing_any_context, count(*) filter (where a) as notes_missing_source_parser, count(*) filter (where b) as notes_missing_heuristic_primary_hint, count(*) filter (where c) as notes_missing_hybrid_live_source,
        count(*) filter (where gap and d > 0) as missing_context_with_matching_completed_state, count(*) filter (where gap and d = 0 and q > 0) as missing_context_with_matching_queued_state, count(*) filter (where gap and d = 0 and q = 0 and k > 0) as missing_context_with_matching_other_state,
        count(*) filter (where gap and k = 0) as missing_context_without_matching_state, count(*) filter (where gap and live) as missing_context_source_file_present, count(*) filter (where gap and not live) as missing_context_source_file_missing from j""",
        "files",
        "states",
    )
)
def note_context_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.files(spark, sf_dir)
    notes = spark.sql(f"select {_NOTE_CONTEXT} from {{f}}", f=files)
    return reports.note_context_gaps(notes, files, b.states(spark, sf_dir), root="/mirror")


@query("select event_id, case when (event_id % 20) / 20.0 < 0.85 then 'teacher-low-confidence' when event_type not in ('view', 'click') then 'teacher-outside-candidates' else 'teacher-approved' end as review_status, (event_id % 20) / 20.0 >= 0.85 and event_type in ('view', 'click') and event_type <> 'view' as suggests_correction from events")
def teacher_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labels.teacher_review(F.col("event_type"), (F.col("event_id") % 20) / 20.0, F.array(F.lit("view"), F.lit("click")), F.lit("view"))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t.review_status", "t.suggests_correction")


@query(with_tables("select file_id, primary_label in ('unknown', 'needs-review') or confidence < 0.7 as review from states", "states"))
def review_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.states(spark, sf_dir).select("file_id", labels.needs_review(F.col("primary_label"), F.col("confidence")).alias("review"))


@query(with_tables("select extension, mime_type, case extension when 'pdf' then 'pdf' when 'csv' then 'spreadsheet' when 'png' then 'images' else 'html_text' end as kind, count(*) as n from files group by extension, mime_type", "files"))
def file_type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).groupBy("extension", "mime_type", labels.file_type_group(F.col("extension"), F.col("mime_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def teacher_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.contents(spark, sf_dir), F.col("id") == F.col("file_id")).withColumn("provider", paths.provider(F.col("path")))
    ranked = labels.ranked_labels(text.join_filled(F.col("name"), F.col("path"), F.substring("content_text", 1, 8000)), F.col("extension"), F.col("mime_type"), {**_ROUTES, "spreadsheet": [], "markdown-note": [], "image-only": []})
    return labels.teacher(rows.withColumn("ranked", ranked)).select("id", "teacher_primary", "teacher_secondary", "teacher_confidence", "ambiguity_score", "teacher_label")


@query("select role, count(*) as n, count(*) filter (where role = 'user') as messages from conversations group by role")
def message_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("path", F.when(F.col("role") == "user", "/a/Text Messages/x").otherwise("/a/notes/x"))
    o = labels.message_override(F.col("path"), F.lit("letter"), F.array().cast("array<string>"), ["/text messages/"])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(o["primary"] == "text-message").alias("messages"))


@query(with_tables("select reason, count(*) as n from (select unnest(list_filter([case when primary_label is null then 'classifier-missing' end, case when primary_label in ('unknown', 'needs-review') then 'classifier-review-label' end, case when confidence < 0.7 then 'classifier-low-confidence' end, case when f.id % 10 < 4 then 'teacher-low-confidence' end, case when primary_label is not null and primary_label <> 'report' then 'teacher-disagreement' end], lambda x: x is not null)) as reason from files f left join states s on s.file_id = f.id) group by reason", "files", "states"))
def dataset_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.states(spark, sf_dir), F.col("id") == F.col("file_id"), "left")
    why = training.review_reasons(F.col("primary_label"), F.col("confidence"), F.lit("report"), (F.col("id") % 10 + 0.5) / 10.0)
    return rows.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("select reason, count(*) as n from (select case when length(content_text) < 300 then 'too-short' when regexp_matches(path, '(^|/)_') then 'hidden' when extension = 'png' then 'image' else 'ok' end as reason from files join contents on file_id = id) group by reason", "files", "contents"))
def example_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.contents(spark, sf_dir), F.col("id") == F.col("file_id"))
    why = training.reject_reason([("too-short", F.length("content_text") < 300), ("hidden", paths.has_hidden_segment(F.col("path"))), ("image", F.col("extension") == "png")])
    return rows.select(why.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_MINE = {"legal": ["license"], "english": ["the "], "french": ["leaux"]}


@query(
    with_tables(
        """, r as (select id, path, lower(content_text) as t from files join contents on file_id = id),
        a as (select id, path, 'legal' as label from r where contains(t, 'license') order by id limit 20),
        c as (select id, path, 'english' as label from r where contains(t, 'the ') and path not in (select path from a) order by id limit 20),
        d as (select id, path, 'french' as label from r where contains(t, 'leaux') and path not in (select path from a) and path not in (select path from c) order by id limit 20)
        select id, path, label from a union all select * from c union all select * from d""",
        "files",
        "contents",
    ).replace(")\n, r as", "), r as")
)
def example_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.contents(spark, sf_dir), F.col("id") == F.col("file_id")).select("id", "path", "content_text")
    return training.mine_examples(rows, _MINE, 20)


@query("select event_id as seq, filename, label from (select event_id, concat('f', user_id) as filename, event_type as label, event_id % 2 = 0 as c, event_id % 3 = 0 as d, value from events) qualify row_number() over (partition by filename, label order by c desc, d desc, value desc, filename, event_id) = 1")
def reviewed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("f"), "user_id").alias("filename"), F.col("event_type").alias("label"), (F.col("event_id") % 2 == 0).alias("confirmed"), (F.col("event_id") % 3 == 0).alias("disagrees"), F.col("value").alias("confidence"))
    return training.import_reviewed(e, 1_000_000).select("seq", "filename", "label")


_TFIDF = """with d as (select item_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from benchmark),
 t as (select id, unnest(w) as term from d union all select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from d),
 c as (select id, term, count(*) as tf from t group by id, term), n as (select count(*) as n from d),
 f as (select term, ln((1.0 + (select n from n)) / (1.0 + count(*))) + 1.0 as idf from c group by term),
 x as (select id, term, (1.0 + ln(tf)) * idf as x from c join f using (term)), w as (select id, term, x / sqrt(sum(x * x) over (partition by id)) as weight from x)"""


@query(_TFIDF + " select id, term, round(weight, 8) as weight from w")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _ = training.fit_tfidf(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content_text")), max_features=None)
    return weights.select("id", "term", F.round("weight", 8).alias("weight"))


@query(_TFIDF + ", s as (select a.id, b.id as r, sum(a.weight * b.weight) as cosine from w a join w b using (term) group by a.id, b.id), l as (select id, 'label' || r % 5 as label, max(cosine) as score from s group by 1, 2) select id, label, round(score, 8) as score from (select *, row_number() over (partition by id order by round(score, 9) desc, label) as place from l) where place <= 3")
def tfidf_router_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content_text"))
    weights, idf = training.fit_tfidf(docs, max_features=None)
    return training.route(docs, idf, weights, docs.select("id", F.concat(F.lit("label"), F.col("id") % 5).alias("label")), k=3).select("id", "label", F.round("score", 8).alias("score"))


@query()
def gbm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees learn the label, whether it was reviewed and whether it differs from the file's language, from all labelled
    documents; every document is scored."""
    docs = b.contents(spark, sf_dir).select(F.col("file_id").alias("id"), "content_text")
    known = b.states(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("primary_label").alias("label"), (F.col("submission_status") == "queued").alias("used_inline_llm"), (F.col("confidence") < 0.5).alias("disagreement"))
    heads = boosting.train_heads(docs.join(known, "id"), most=2_000, rounds=4, depth=3)
    scored = boosting.predict_heads(docs, heads)
    return scored.select("id", "top_label", F.round("top_probability", 9).alias("top_probability"), "top_labels", F.round("needs_llm_probability", 9).alias("needs_llm_probability"), F.round("disagreement_risk", 9).alias("disagreement_risk"))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    quotas = training.weighted_counts(60, {"en": 3, "fr": 2, "de": 1, "es": 1})
    return training.stratified_sample(rows, [*((k, F.col("lang") == k, n) for k, n in quotas.items()), ("long", F.col("n_chars") > 3000, 10), ("rest", F.lit(True), 20)], seed=13)


@query(with_tables("select id, 'label-' || split_part(ltrim(path, '/'), '/', 2) as label from files where split_part(ltrim(path, '/'), '/', 2) in ('en', 'de') and id % 97 <> 0", "files"))
def folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.slice(F.split(F.ltrim(F.col("path"), F.lit("/")), "/"), 1, 2)
    return b.files(spark, sf_dir).select("id", reconcile.folder_label(parts, {"en": "label-en", "de": "label-de"}).alias("label")).where("label is not null")


@query("select doc_id as file_id, regexp_extract(text, '^[^.\\n]*') as head, list_distinct(list_transform(list_filter(string_split(replace(coalesce(lang, ''), 'e', ','), ','), lambda x: trim(x) <> ''), lambda x: trim(x))) as parts from documents")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("head"), F.array_distinct(text.split_list(F.replace("lang", F.lit("e"), F.lit(",")))).alias("parts"))


# --- reconciliation and incremental work


@query(
    with_tables(
        """, seen as (select id, size_bytes + case when id % 11 = 0 then 1 else 0 end as size_bytes from files where id % 5 <> 0 union all select 1000000 + id, 1 from files where id < 10)
        select coalesce('ext-' || f.id, 'ext-' || s.id) as external_id, coalesce(s.size_bytes, f.size_bytes) as size_bytes, s.id is null as is_deleted,
        case when f.id is null then 'inserted' when s.id is not null and f.is_deleted then 'restored' when s.id is not null and s.size_bytes <> f.size_bytes then 'updated' when s.id is null and not f.is_deleted then 'deleted' else 'unchanged' end as change
        from files f full outer join seen s on s.id = f.id""",
        "files",
    ).replace(")\n, seen", "), seen")
)
def snapshot_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.files(spark, sf_dir)
    again = f.where("id % 5 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("id") % 11 == 0, 1).otherwise(0))
    new = f.where("id < 10").withColumns({"external_id": F.concat(F.lit("ext-"), (1_000_000 + F.col("id")).cast("string")), "size_bytes": F.lit(1).cast("long")})
    out = reconcile.reconcile_snapshot(f, again.unionByName(new), complete=True)
    return out.select("external_id", "size_bytes", "is_deleted", "change")


@query("select doc_id as file_id, case when doc_id % 4 = 0 then text when doc_id % 4 = 2 then 'new ' || doc_id else text end as content_text from documents where doc_id % 4 <> 1")
def text_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.contents(spark, sf_dir)
    x = c.where("file_id % 4 < 3").select("file_id", F.when(F.col("file_id") % 4 == 1, "").otherwise(F.concat(F.lit("new "), "file_id")).alias("content_text"), (F.col("file_id") % 4 == 0).alias("failed"))
    return reconcile.replace_texts(c, x).select("file_id", "content_text")


@query("select user_id as path, event_id as id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.restore_plan(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("id"), "event_type"))


@query("select min(event_id) as id, concat(event_type, '-', user_id % 50) as key from events where event_type <> 'view' and event_id >= 500 group by 2")
def queue_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("-"), F.col("user_id") % 50).alias("key"), "event_type")
    return queueing.queue_once(e.where("id >= 500"), e.where("event_type = 'view'"), "key").select("id", "key")


@query("select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(text.json_object(F.col("props"))["k"].cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as body from pages")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.html_text(F.col("html")).alias("body"))


@query(with_tables("select id, extension, path from files left join contents on file_id = id where contains(lower(name), 'license') or contains(lower(path), 'license') or contains(lower(content_text), 'license') or extension in ('png') order by id limit 80", "files", "contents"))
def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.candidates_by_patterns(b.files(spark, sf_dir), b.contents(spark, sf_dir), ["license"], ["png"], 3)


@query(with_tables("select id, name, path, extension, substr(content_text, 1, 1200) as content_text from files join contents on file_id = id where not is_deleted", "files", "contents"))
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.corpus(b.files(spark, sf_dir), b.contents(spark, sf_dir))


@query(with_tables("select id, path from files where (path like '%/en/%' or path like '%.csv') and not path like '/src1%'", "files"))
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).where(paths.matches_globs(F.col("path"), ["*/en/*", "*.csv"], ["/src1*"])).select("id", "path")


@query("select o_orderpriority as status, count(*) as n, sum(o_totalprice) as total from orders group by 1")
def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


# --- status, notes, refresh control


@query(with_tables("select root, count(id) as n from (values ('src1'), ('src2/en'), ('src3/fr'), ('nowhere')) r(root) left join files on starts_with(path, '/' || root || '/') group by root", "files"))
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.folder_counts(b.files(spark, sf_dir), ["src1", "src2/en", "src3/fr", "nowhere"])


@query(with_tables("select r as reason, count(*) as n, count(*) filter (where pos = 1) as n_first from (select unnest(l) as r, generate_subscripts(l, 1) as pos from (select list_filter([case when length(content_text) < 300 then 'short' end, case when extension = 'png' then 'image' end, case when regexp_matches(path, '(^|/)_') then 'hidden' end], lambda x: x is not null) as l from files join contents on file_id = id)) group by r", "files", "contents"))
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.files(spark, sf_dir).join(b.contents(spark, sf_dir), F.col("id") == F.col("file_id"))
    why = F.array_compact(F.array(F.when(F.length("content_text") < 300, "short"), F.when(F.col("extension") == "png", "image"), F.when(paths.has_hidden_segment(F.col("path")), "hidden")))
    return status.reason_counts(rows, why)


@query(with_tables("select 'jobs' as section, status as key, count(*) as n from jobs group by 2 union all select 'states', submission_status, count(*) from states group by 2 union all select 'providers', split_part(ltrim(path, '/'), '/', 1), count(*) from files where not is_deleted group by 2 union all select 'notes', 'all', count(*) from pages", "jobs", "states", "files"))
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = b.files(spark, sf_dir).where(~F.col("is_deleted"))
    return status.summary({"jobs": (b.jobs(spark, sf_dir), F.col("status")), "states": (b.states(spark, sf_dir), F.col("submission_status")), "providers": (live, paths.provider(F.col("path"))), "notes": (b.notes(spark, sf_dir), F.lit("all"))})


@query(with_tables("select id, path from files where path ilike '%MENT 1_.txt'", "files"))
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).where(status.ends_with(F.col("path"), F.lit("MENT 1_.txt"))).select("id", "path")


@query("select source, list_has_all(['en', 'fr', 'de'], list(distinct lang)) as known from documents group by source")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return langs.select("source", status.is_subset(F.col("l"), F.array(F.lit("en"), F.lit("fr"), F.lit("de"))).alias("known"))


@query("select user_id, min(event_id) as first from events group by user_id order by first limit 50")
def first_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.first_distinct(table(spark, sf_dir, "events"), "user_id", "event_id")


@query(with_tables("select id, name, case extension when 'pdf' then 'application/pdf' when 'csv' then 'text/csv' when 'png' then 'image/png' when 'md' then 'text/markdown' else 'text/plain' end as guessed from files", "files"))
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).select("id", "name", status.content_type(F.col("name")).alias("guessed"))


_NOTE_NAME = "case doc_id % 3 when 0 then 'Note - ' || substr(sha256(text), 1, 8) || '.md' when 1 then substr(sha256(text), 1, 16) || '-x.md' else 'Note (' || doc_id || ').md' end"


@query(f"select doc_id, doc_id % 3 < 2 as noisy, case when doc_id % 3 = 2 then doc_id else 0 end as rank, {_NOTE_NAME} as name from documents")
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Note - "), F.substring(sha, 1, 8), F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(sha, 1, 16), F.lit("-x.md"))).otherwise(F.concat(F.lit("Note ("), "doc_id", F.lit(").md")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", status.hash_noise(F.col("name")).alias("noisy"), status.suffix_rank(F.col("name")).alias("rank"), "name")


@query(with_tables("select f.id, primary_label, n.note is not null as note_available, coalesce(length(n.note), 0) as note_length, coalesce(length(n.note), 0) > 500 as note_truncated, substr(coalesce(n.note, ''), 1, 500) as note_content, case when n.id % 2 = 0 then '/vault/' || n.id else path end as canonical_source_path from files f left join states s on s.file_id = f.id left join (select page_id as id, html as note from pages) n on n.id = f.id where not is_deleted", "files", "states"))
def note_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.when(F.col("file_id") % 2 == 0, F.create_map(F.lit("canonical_source_path"), F.concat(F.lit("/vault/"), "file_id"))).otherwise(F.create_map().cast("map<string,string>"))
    notes = b.notes(spark, sf_dir).select("file_id", "note_text", meta.alias("metadata"))
    live = b.files(spark, sf_dir).where(~F.col("is_deleted"))
    return status.note_details(live, b.states(spark, sf_dir), notes, most=500).select("id", "primary_label", "note_available", "note_length", "note_truncated", "note_content", "canonical_source_path")


@query(with_tables("select id, case when status = 'running' and file_id % 2 = 0 then 'completed' else status end as status, status = 'running' and file_id % 2 = 0 as swapped from jobs", "jobs"))
def lease_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.jobs(spark, sf_dir).select("id", "status", "file_id", F.col("props").alias("payload"))
    updates = j.select("id", F.when(F.col("file_id") % 2 == 0, F.col("payload")).otherwise("another").alias("expected"), F.lit("completed").alias("next_status"), F.lit("{}").alias("next_payload"))
    return status.swap_leases(j.drop("file_id"), updates).select("id", "status", "swapped")


@query(with_tables("select j.id, case when status = 'queued' and starts_with(path, '/src1/') then timestamp '2024-01-15 02:00:00' else next_attempt_at end as next_attempt_at, case when status = 'queued' and starts_with(path, '/src1/') then 'deferred' end as error from jobs j join files f on f.id = j.file_id", "jobs", "files"))
def deferred_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.jobs(spark, sf_dir).join(b.files(spark, sf_dir).select(F.col("id").alias("file_id"), "path"), "file_id").withColumn("error", F.lit(None).cast("string"))
    return status.deferred(rows, F.col("path"), "/src1/", F.lit("2024-01-15").cast("timestamp")).select("id", "next_attempt_at", "error")


@query("select max(ts) filter (where event_type = 'purchase') as last_completed_at, count(*) filter (where event_type = 'refund') > 0 as busy, count(*) filter (where event_type = 'refund') = 0 and epoch(timestamp '2030-01-01') - epoch(max(ts) filter (where event_type = 'purchase')) >= 1800 as due from events")
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return status.refresh_due(e.where("event_type = 'purchase'").select(F.col("ts").alias("completed_at")), e.where("event_type = 'refund'"), F.lit("2030-01-01").cast("timestamp"))


@query("select coalesce(a.path, s.path) as path, coalesce(s.hash, a.hash) as hash, case when a.path is null then 'inserted' when s.path is null then 'missing' when a.hash <> s.hash then 'updated' else 'unchanged' end as change from (select 'note ' || doc_id as path, sha256(text) as hash from documents where doc_id % 4 <> 0) a full join (select 'note ' || doc_id as path, sha256(case when doc_id % 7 = 0 then 'new' else text end) as hash from documents where doc_id % 5 <> 0) s on a.path = s.path")
def note_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("note "), "doc_id").alias("path")
    index = d.where("doc_id % 4 <> 0").select(path, F.sha2("text", 256).alias("hash"))
    scanned = d.where("doc_id % 5 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, "new").otherwise(F.col("text")), 256).alias("hash"))
    return status.upsert_notes(index, scanned)


@query("select split_part(split_part(url, '://', 2), '/', 1) as key, count(*) as n from pages group by 1")
def note_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return reports.counts_by(b.notes(spark, sf_dir), host)


@query("with v as (select vec_id, embedding::double[] as e from embeddings) select query_id, id, place, round(cosine, 6) as cosine from (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(a.e, b.e) as cosine, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 9) desc, b.vec_id) as place from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where place <= 5")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return vectors.cosine_topk(v, F.col("id") % 100 == 0).select("query_id", "id", "place", F.round("cosine", 6).alias("cosine"))


# --- feedback of people


#: Notes of documents: (root, folder, head fields) by number; SQL says what each of them tells from the same numbers.
_NOTE_PARTS = """select doc_id as i, case doc_id % 4 when 0 then '01 Classified/' when 1 then '02 Needs Review/' when 2 then '' else 'Mine/' end as root,
    case doc_id % 6 when 0 then 'Reports' when 1 then 'report' when 2 then 'Invoices & Bills/2024' when 3 then 'misc' when 4 then 'Medical/Appeals' else lang end as folder,
    doc_id % 3 < 2 as generated, case doc_id % 5 when 1 then 'report' when 2 then 'medical' when 3 then 'invoice' end as label, doc_id % 2 = 0 as appeals,
    case doc_id % 7 when 0 then 'review' when 1 then 'ignore' end as action, doc_id % 9 > 0 as has_source, doc_id % 8 = 0 as has_heading, doc_id % 31 = 0 as skipped, doc_id % 11 = 0 as read_before, {rest} from {docs}"""
_NOTE_LABELS = ["report", "medical", "invoice", "policy"]
_NOTE_FOLDERS = {"Invoices-Bills/2024": ("financial", ["invoice"]), "medical/appeal": ("insurance", ["medical"]), "en": ("english", [])}


@query(
    """with p as ("""
    + _NOTE_PARTS.format(rest="lang", docs="documents")
    + """ where not (doc_id % 31 = 0)), h as (
        select *, case i % 6 when 0 then 'report' when 1 then 'report' when 2 then 'financial' when 4 then 'insurance' when 5 then case when lang = 'en' then 'english' end end as hint,
            case i % 6 when 2 then ['invoice'] when 4 then ['medical'] else []::varchar[] end as hint_more, case when appeals then ['Appeals'] else []::varchar[] end as own_more,
            case when i % 6 < 2 then 'derived-folder-label' when i % 6 in (2, 4) or lang = 'en' and i % 6 = 5 then 'explicit-folder-map' else '' end as source,
            case when has_source then '/srv/' || i || '.pdf' else '/vault/' || root || folder || '/Note ' || i || '.md' end as source_path
        from p
    ), k as (
        select * from h where case when generated then
            coalesce(hint, label) is not null
            and not (root in ('01 Classified/', '02 Needs Review/') and coalesce(folder = label or label = 'medical' and appeals and folder = 'medical/appeals', false)
                     and not coalesce(root = '01 Classified/' and action = 'review' or root = '02 Needs Review/' and action = 'ignore', false))
            and not (coalesce(hint, label) = coalesce(label, 'unknown') and list_transform(hint_more, x -> x) = list_transform(own_more, x -> 'appeal'))
        else true end
    )
    select i as note_id, source_path, case when generated then coalesce(hint, label) else coalesce(label, hint, 'markdown-note') end as correct_label,
        case when generated then coalesce(label, 'unknown') else 'unknown' end as old_label,
        array_to_string(case when generated or label is null then hint_more else own_more end, ',') as secondary, case when has_heading then 'Heading ' || i else 'Note ' || i end as summary,
        case when not generated then 'obsidian-markdown' when read_before then 'docx' else 'obsidian-generated-note' end as parser,
        case when generated then 'manual-note-move' when label is not null or hint is null then 'manual-obsidian-note' else 'manual-folder-weak-label' end as review_status,
        case when not generated and label is null and hint is not null then 'weak' else 'strong' end as feedback_strength, source as folder_match_source
    from k""".replace("x -> x", "lambda x: x").replace("x -> 'appeal'", "lambda x: 'appeal'")
)
def manual_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels told by a note of each document, its text following the head."""
    p = spark.sql(_NOTE_PARTS.format(rest="text", docs="{d}"), d=table(spark, sf_dir, "documents"))
    c, i = F.col, F.col("i").cast("string")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\n", F.lit("---"), F.when(c("generated"), "type: classified-document"), field("primary_label", F.concat(F.lit('"'), c("label"), F.lit('"'))), F.when(c("appeals"), 'secondary_labels: ["Appeals"]'),
        field("recommended_action", c("action")), F.when(c("has_source"), field("source_file", F.concat(F.lit("/srv/"), i, F.lit(".pdf")))), F.when(c("read_before"), "source_parser: docx"), F.lit("---"),
        F.when(c("has_heading"), F.concat(F.lit("# Heading "), i)), F.regexp_replace(F.coalesce("text", F.lit("")), "(^|[\n\r])[ \t]*# ", "$1#"),
    )
    relative = F.concat(F.when(c("skipped"), ".obsidian/").otherwise(""), "root", "folder", F.lit("/Note "), i, F.lit(".md"))
    notes = p.select(relative.alias("relative_path"), F.concat(F.lit("/vault/"), relative).alias("path"), head.alias("note_text"))
    told = feedback.manual_feedback(notes, labels=_NOTE_LABELS, folder_map=_NOTE_FOLDERS)
    number = F.regexp_extract("source_filename", "[0-9]+", 0).cast("long").alias("note_id")
    return told.select(number, "source_path", "correct_label", "old_label", F.array_join("secondary_labels", ",").alias("secondary"), "summary", "parser", "review_status", "feedback_strength", "folder_match_source")


# --- the training dataset


_DATASET_RULES = {**_ROUTES, "spreadsheet": [], "markdown-note": [], "image-only": []}


def _bonus_sql(label: str) -> tuple[str, str]:
    """Points and evidence of extension and type in SQL."""
    ext = {"spreadsheet": ("csv", 4), "markdown-note": ("md", 4), "image-only": ("png", 2)}.get(label)
    mime = {"markdown-note": "text/", "legal": "application/pdf"}.get(label)
    tests = ([(f"extension = '{ext[0]}'", ext[1])] if ext else []) + ([(f"starts_with(mime_type, '{mime}')", 1)] if mime else [])
    return "".join(f" + case when {t} then {n} else 0 end" for t, n in tests), "".join(f" + ({t})::int" for t, _ in tests)


def _ranks_sql(body: str) -> str:
    parts = []
    for label, words in _DATASET_RULES.items():
        points, marks = _bonus_sql(label)
        score = "".join(f" + case when contains({body}, '{w}') then {2 if len(w) > 4 else 1} else 0 end" for w in words)
        parts.append(f"select id, '{label}' as label, 0{score}{points} as score, 0{''.join(f' + contains({body}, {chr(39)}{w}{chr(39)})::int' for w in words)}{marks} as n from q")
    return " union all ".join(parts)


_DATASET_SQL = with_tables(
    """, r as (select f.*, coalesce(substr(content_text, 1, 4000), '') as body from files f left join contents c on c.file_id = f.id where not is_deleted),
    q as (select *, lower(name) || ' ' || lower(path) as head, lower(name) || ' ' || lower(path) || case when trim(body, {w}) = '' then '' else ' ' || trim(lower(body), {w}) end as t from r),
    al as (select * from (values {aliases}) t(label, alias)),
    ph as (select id, ' ' || trim(regexp_replace(replace(t, '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' as p from q),
    hit as (select id, label, alias, 2 + least(len(string_split(alias, ' ')), 3) as points from ph join al on contains(p, ' ' || alias || ' ')),
    m as (select *, row_number() over (partition by id order by score desc, label) as place from (select id, label, sum(points)::int as score, list_sort(list(distinct alias))[1:4] as evidence from hit group by id, label) qualify place <= 8),
    s as ({full}),
    b as (select coalesce(s.id, e.id) as id, coalesce(s.label, e.label) as label, coalesce(s.score, 0) + case when e.score is null then 0 else greatest(2, e.score) end as score,
          coalesce(s.n, 0) + coalesce(len(e.evidence), 0) - case when s.label = 'legal' and list_contains(e.evidence, 'license') then 1 else 0 end as n
          from s full join (select * from m where place <= 6) e on e.id = s.id and e.label = s.label),
    k as (select *, row_number() over (partition by id order by score desc, n desc, label desc) as place from b),
    su as (select id, arg_max(label, (score, n, label)) as surface, max(score) as points from ({surface}) group by id),
    two as (select k.id, k.label as l1, k.score as s1, z.label as l2, z.score as s2, z.n as n2 from k join k z on z.id = k.id and z.place = 2 where k.place = 1),
    te as (select q.*, l2, greatest(0, s2 - s1 + n2) as ambiguity_score, case when s1 > 0 then l1 when extension = 'png' then 'image-only' when extension = 'csv' then 'spreadsheet' else 'unknown' end as l,
           case when s1 > 0 then round(s1 / greatest(s1 + s2, 1), 4) when extension = 'png' then 0.25 when extension = 'csv' then 0.35 else 0.0 end as conf,
           surface, case when points > 0 then round(points / (points + 1), 4) else 0.0 end as surface_confidence from q join two using (id) join su using (id)),
    tl as (select *, case when conf < 0.3 then 'unknown' when conf < 0.45 and l not in ('unknown', 'needs-review') then 'needs-review' else l end as tlabel from te),
    ca as (select id, string_agg(label, ',' order by place) as candidates from m group by id)
    select tl.id as file_id, split_part(path, '/', 2) as provider, extension, coalesce(submission_status, '') as submission_status, coalesce(primary_label, '') as classifier_primary_label,
        case extension when 'png' then 'reference-image' when 'csv' then 'spreadsheet' when 'md' then 'markdown-note' when 'txt' then 'work' else case when conf < 0.35 then 'needs-review' else l end end as naive_label,
        tlabel as teacher_label, l as teacher_primary, l2 as teacher_secondary, conf as teacher_confidence, ambiguity_score, surface as surface_primary, surface_confidence,
        array_to_string(list_filter([{topics}], lambda x: x is not null), ',') as topics, coalesce(candidates, '') as candidates,
        case when primary_label is null or primary_label in ('unknown', 'needs-review') then tlabel else primary_label end as training_target_label,
        array_to_string(list_filter([case when primary_label is null then 'missing-classifier-label' when primary_label in ('unknown', 'needs-review') then 'classifier-review-label' end, case when confidence < 0.7 then 'classifier-low-confidence' end,
            case when conf < 0.45 then 'teacher-low-confidence' end, case when primary_label not in ('unknown', 'needs-review') and primary_label <> l then 'teacher-current-disagreement' end], lambda x: x is not null), ',') as reasons,
        sha256(substr(t, 1, 4000)) as preview_sha256
    from tl left join states st on st.file_id = tl.id left join ca on ca.id = tl.id""".format(
        w="' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)",
        aliases=", ".join(f"('{x}', '{y}')" for x, y in _ALIASES),
        full=_ranks_sql("t"),
        surface=_ranks_sql("head"),
        topics=", ".join(f"case when regexp_matches(t, '{'|'.join(words)}') then '{k}' end" for k, words in dataset.SENSITIVE.items()),
    ),
    "files",
    "contents",
    "states",
).replace(")\n, r as", "), r as")


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = dataset.training_corpus(b.files(spark, sf_dir), b.contents(spark, sf_dir), b.states(spark, sf_dir))
    return dataset.training_dataset(dataset.annotate(corpus, _DATASET_RULES, spark.createDataFrame(_ALIASES, "local string, alias string")))


@query(_DATASET_SQL)
def training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All live files with what the classifier, rules and aliases tell about them, and why to review them."""
    joined = lambda name: F.array_join(name, ",")
    return _dataset(spark, sf_dir).select(
        "file_id", "provider", "extension", "submission_status", "classifier_primary_label", "naive_label", "teacher_label", "teacher_primary", "teacher_secondary", "teacher_confidence", "ambiguity_score",
        "surface_primary", "surface_confidence", joined("sensitive_topics").alias("topics"), joined("taxonomy_candidates").alias("candidates"), "training_target_label", joined("review_reasons").alias("reasons"),
        F.sha2("text_preview", 256).alias("preview_sha256"),
    )


@query(
    f"""with d as ({_DATASET_SQL}), each as (
        select unnest([{{'m': 'provider', 'k': provider}}, {{'m': 'submission_status', 'k': case when submission_status = '' then 'unsubmitted' else submission_status end}},
            {{'m': 'classifier_label', 'k': case when classifier_primary_label = '' then 'unclassified' else classifier_primary_label end}}, {{'m': 'teacher_label', 'k': teacher_label}}, {{'m': 'training_target', 'k': training_target_label}},
            {{'m': 'file_type', 'k': case extension when 'pdf' then 'pdf' when 'csv' then 'spreadsheet' when 'png' then 'images' else 'html_text' end}}, {{'m': 'rows', 'k': null}}]) as r from d
        union all select {{'m': 'with_state', 'k': null}} from d where submission_status <> '' union all select {{'m': 'review_recommended', 'k': null}} from d where reasons <> ''
        union all select {{'m': 'teacher_current_disagreement', 'k': null}} from d where contains(reasons, 'teacher-current-disagreement')
        union all select {{'m': 'sensitive_topic', 'k': unnest(string_split(topics, ','))}} from d where topics <> '' union all select {{'m': 'review_reason', 'k': unnest(string_split(reasons, ','))}} from d where reasons <> ''
        union all select {{'m': 'taxonomy_candidate', 'k': unnest(string_split(candidates, ',')[1:3])}} from d where candidates <> ''
    ) select r.m as metric, r.k as key, count(*) as n from each group by 1, 2"""
)
def training_dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.dataset_report(_dataset(spark, sf_dir))


_FEEDS_SQL = """, f as (
        select 'correction' as feedback_source, concat('doc', id, '.', extension) as filename, primary_label as accepted, case when id % 3 = 0 then 'note' end as old_label, null as review_status, 'pdf-text' as parser, '' as source_path
        from files join states on file_id = id where id % 2 = 0
        union all select 'manual-obsidian-note', 'example', case when id % 4 > 0 then 'letter' else '' end, case when id % 5 = 0 then 'letter' else 'note' end, 'manual-note-move', '', '/srv/' || id || '.MD' from files where id % 3 = 0
    ), g as (select *, case when filename = 'example' then string_split(source_path, '/')[3] else filename end as name from f where accepted <> '' and not (review_status is not null and accepted = old_label)),
    fb as (select feedback_source, name as filename, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) as extension, parser, coalesce(old_label, accepted) as heuristic_primary, accepted as live_primary, coalesce(review_status, 'teacher-approved-bootstrap') as teacher_review_status,
        old_label is not null as teacher_suggests_correction, concat_ws(' ', nullif(source_path, ''), old_label) as text_preview from g)"""


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, files = F.col("id"), b.files(spark, sf_dir)
    corrected = files.where(i % 2 == 0).join(b.states(spark, sf_dir), i == F.col("file_id"))
    corrections = corrected.select(F.concat(F.lit("doc"), "id", F.lit("."), "extension").alias("filename"), "primary_label", F.when(i % 3 == 0, "note").alias("old_label"), F.lit("pdf-text").alias("parser"))
    notes = files.where(i % 3 == 0).select(F.when(i % 4 > 0, "letter").otherwise("").alias("correct_label"), F.when(i % 5 == 0, "letter").otherwise("note").alias("old_label"), F.lit("manual-note-move").alias("review_status"), F.concat(F.lit("/srv/"), "id", F.lit(".MD")).alias("source_path"))
    return feedback.bootstrap_feedback({"correction": corrections, "manual-obsidian-note": notes})


@query(with_tables(_FEEDS_SQL + " select * from fb", "files", "states").replace(")\n, f as", "), f as"))
def bootstrap_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir).select("feedback_source", "filename", "extension", "parser", "heuristic_primary", "live_primary", "teacher_review_status", "teacher_suggests_correction", "text_preview")


@query(
    with_tables(
        _FEEDS_SQL
        + """, a as (select count(*) as reviewed, count(*) as samples, count(*) as agreeing, count(distinct filename) as files, array_to_string(list_sort(list(distinct extension)), ',') as extensions,
            array_to_string(list_sort(list(distinct live_primary)), ',') as labels, array_to_string(list_sort(list(distinct parser) filter (where parser <> '')), ',') as parsers, (select count(*) from jobs where status = 'queued') as queue_depth from fb)
        select reviewed, samples, agreeing, 1.0::double as approval_rate, 1.0::double as agreement_rate, files, extensions, labels, parsers, queue_depth, false as thresholds_pass,
            (select string_agg(feedback_source || '=' || n, ',' order by feedback_source) from (select feedback_source, count(*) as n from fb group by 1)) as sources,
            'insufficient-teacher-label-coverage,shadow-queue-backlog-too-deep' as warnings from a""",
        "files",
        "states",
        "jobs",
    ).replace(")\n, f as", "), f as")
)
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness by the feedback of all feeds; what waits are the queued jobs."""
    report = feedback.readiness_report(_feeds(spark, sf_dir), b.jobs(spark, sf_dir).where("status = 'queued'"), model_exists=True, thresholds={"labels": 9})
    sources = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    lists = {"extensions": "extension_list", "labels": "label_list", "parsers": "parser_list", "warnings": "warnings"}
    return report.select("reviewed", "samples", "agreeing", "approval_rate", "agreement_rate", "files", *(F.array_join(c, ",").alias(n) for n, c in lists.items()), sources.alias("sources"), "queue_depth", "thresholds_pass")


_REQUEUE_FILES = "select id, extension, is_deleted, case when id % 5 = 0 then concat('/x/SMS/', name) else path end as path from {f}"
_REQUEUE_STATES = """select file_id, case when file_id % 10 = 0 then null else primary_label end as primary_label, case when file_id % 3 > 0 then timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(file_id % 40 as int)) end as completed_at,
    case when file_id % 2 = 0 then 'completed' else submission_status end as submission_status, case when file_id % 15 = 0 then '/vault/02 Needs Review/n.md' end as classifier_note_path from {s}"""


@query(
    with_tables(
        ", f as ("
        + _REQUEUE_FILES.format(f="files")
        + "), s as ("
        + _REQUEUE_STATES.format(s="states").replace("make_interval(0, 0, 0, cast(file_id % 40 as int))", "to_days((file_id % 40)::int)")
        + """), t as (select id as file_id, 0 as feed from f left join s on s.file_id = f.id where id % 4 = 0 and (completed_at is null or timestamp '2024-01-20' > completed_at) and coalesce(primary_label, '') <> 'report'),
        m as (select id as file_id, 1 as feed from f join s on s.file_id = f.id where not is_deleted and contains(lower(path), '/sms/') and submission_status = 'completed' and (coalesce(primary_label, '') = '' or starts_with(classifier_note_path, '/vault/02 Needs Review/')))
        select file_id, min(feed)::int as feed from (select * from t union all select * from m) where file_id not in (select file_id from jobs where status in ('queued', 'running') and id % 3 = 0) group by file_id order by 2, 1 limit 60""",
        "files",
        "states",
        "jobs",
    ).replace(")\n, f as", "), f as")
)
def requeue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds of the queue: feedback on every fourth file, and messages without a label or waiting for a review."""
    f = spark.sql(_REQUEUE_FILES, f=b.files(spark, sf_dir))
    s = spark.sql(_REQUEUE_STATES, s=b.states(spark, sf_dir))
    told = f.where("id % 4 = 0").select("id", F.col("id").alias("file_id"), F.lit("report").alias("label"), F.lit("2024-01-20").cast("timestamp").alias("recorded_at"))
    return queueing.requeue_all(told, f, s, b.jobs(spark, sf_dir).where("id % 3 = 0"), 60)


_RAW_NAMES = "concat(' ', upper(lang), case doc_id % 3 when 0 then ' & ' when 1 then '/' else '!_' end, source, '.x ', case when doc_id % 2 = 0 then '# Note - ' else '-' end, doc_id % 5) as raw"


@query(
    f"""with r as (select {_RAW_NAMES} from documents), c as (select raw, trim(lower(raw)) as low from r)
    select raw, trim(regexp_replace(regexp_replace(low, '[^a-z0-9._/ -]', ' ', 'g'), '\\s+', '-', 'g'), '-') as route,
        trim(regexp_replace(regexp_replace(replace(trim(split_part(low, '#', 1)), '&', ' and '), '[^a-z0-9._/ -]', ' ', 'g'), '\\s+', '-', 'g'), '-') as category,
        trim(regexp_replace(replace(low, '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') as alias, count(*) as n from c group by all"""
)
def label_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    rows = spark.sql(f"select {_RAW_NAMES} from {{d}}", d=table(spark, sf_dir, "documents"))
    return rows.groupBy(raw, text.route_label(raw).alias("route"), text.category_label(raw).alias("category"), text.alias_label(raw).alias("alias")).agg(F.count(F.lit(1)).alias("n"))
