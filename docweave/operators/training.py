"""Training data: samples, examples, the TF-IDF router and its feedback."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions.ranks import numbered
from docweave.operators.sparse import best_labels


def equal_counts(total: int, keys: list[str]) -> dict[str, int]:
    """An equal split; what is left over goes to the first keys."""
    each, more = divmod(total, len(keys)) if keys else (0, 0)
    return {k: each + (i < more) for i, k in enumerate(keys)}


def weighted_counts(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Largest remainders: whole parts first, then one each by falling fraction, ties by key."""
    whole = sum(weights.values())
    if not whole:
        return dict.fromkeys(weights, 0)
    quota = {k: total * w / whole for k, w in weights.items()}
    out = {k: math.floor(q) for k, q in quota.items()}
    for k in sorted(quota, key=lambda k: (-(quota[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def _worked_off(candidates: DataFrame, names: list[str], quotas: list[int], schema: str) -> DataFrame:
    """Groups worked off in order: each takes its quota of candidates (at, key, id) that no earlier group took by its key. There
    are no more candidates than the quotas allow for, so one task holds them."""

    columns = [field.split(" ")[0] for field in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        parts = []
        for at, (name, quota) in enumerate(zip(names, quotas, strict=True)):
            own = pdf[(pdf["at"] == at) & ~pdf["key"].isin(gone)].sort_values(["place", "id"]).head(quota)
            gone |= set(own["key"])
            parts.append(own.assign(name=name))
        return pd.concat(parts)[["id", "key", "name"]].set_axis(columns, axis=1)

    return candidates.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, schema)


def stratified_sample(rows: DataFrame, buckets: list[tuple[str, Column, int]], seed: int) -> DataFrame:
    """Rows drawn bucket by bucket without replacement: each id belongs to the first bucket it fits that still has room when its
    turn comes. Order in a bucket is a seeded hash of the id. No more than the sum of all quotas can be asked of a bucket."""
    most = sum(quota for _, _, quota in buckets)
    fits = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(i).alias("at"), F.xxhash64("id", F.lit(seed + i)).alias("place"))) for i, (_, cond, _) in enumerate(buckets))))
    each = rows.select("id", F.explode(fits).alias("f")).select("id", F.col("id").alias("key"), "f.*").distinct()
    n = F.row_number().over(Window.partitionBy("at").orderBy("place", "id"))
    first = each.withColumn("n", n).where(F.col("n") <= most).drop("n")
    id_type = rows.schema["id"].dataType.simpleString()
    drawn = _worked_off(first, [b[0] for b in buckets], [b[2] for b in buckets], f"id {id_type}, key {id_type}, bucket string")
    return rows.join(drawn.select("id", "bucket"), "id")


def round_robin(rows: DataFrame, group: str) -> DataFrame:
    """Rows interleaved by group: all firsts, then all seconds."""
    return numbered(rows, group, "id", "turn").orderBy("turn", group)


def review_reasons(label: Column, confidence: Column, teacher_label: Column, teacher_confidence: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(label.isNull(), F.lit("classifier-missing")),
            F.when(label.isin("unknown", "needs-review"), F.lit("classifier-review-label")),
            F.when(confidence < 0.70, F.lit("classifier-low-confidence")),
            F.when(teacher_confidence < 0.45, F.lit("teacher-low-confidence")),
            F.when(label.isNotNull() & (teacher_label != label), F.lit("teacher-disagreement")),
        )
    )


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails, or ok."""
    return reduce(lambda w, r: w.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise("ok")


def mine_examples(rows: DataFrame, specs: dict[str, list[str]], quota: int) -> DataFrame:
    """(id, path, label): for each label in order, the first ``quota`` files by id with one of its words whose path no earlier
    label took. Texts are searched once for all labels. Earlier labels take at most ``quota`` paths each, so of each label only
    the first paths by their smallest id, as many as all quotas together, can matter, and of each path its first rows."""
    most = quota * len(specs)
    hits = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(F.lower("content_text"), F.lit(w)) for w in words)), i) for i, words in enumerate(specs.values()))))
    each = rows.select("id", F.col("path").alias("key"), F.explode(hits).alias("at"))
    own = F.row_number().over(Window.partitionBy("at", "key").orderBy("id"))
    paths = each.withColumn("n", own).where(F.col("n") <= quota).groupBy("at", "key").agg(F.min("id").alias("place"), F.collect_list("id").alias("ids"))
    n = F.row_number().over(Window.partitionBy("at").orderBy("place", "key"))
    first = paths.withColumn("n", n).where(F.col("n") <= most).select("at", "key", F.explode("ids").alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()
    return _worked_off(first.withColumn("place", F.col("id")), list(specs), [quota] * len(specs), f"id {id_type}, path string, label string")


def import_reviewed(rows: DataFrame, per_label: int) -> DataFrame:
    """Reviewed rows, confirmed and disagreeing ones first, then by confidence and name; ``per_label`` of each label, and one
    of each name and label."""
    order = [F.desc("confirmed"), F.desc("disagrees"), F.desc("confidence"), F.col("filename"), F.col("seq")]
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("filename", "label").orderBy(*order))).where("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("n") <= per_label).drop("n")


def label_quota(rows: DataFrame, label: str, quota: int) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(label).orderBy("id"))).where(F.col("n") <= quota).drop("n")


def feedback_rows(feeds: dict[str, DataFrame]) -> DataFrame:
    """Feeds of differing columns in one frame, by name; moves that change nothing are left out."""
    out = None
    for name, feed in feeds.items():
        part = feed.withColumn("feedback_source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.where(~F.coalesce(F.col("old_label") == F.col("correct_label"), F.lit(False)))


def _terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: i < F.size("w")), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))
    return df.select(id_col, words.alias("w")).select(id_col, F.explode(F.concat("w", pairs)).alias("term"))


def count_terms(df: DataFrame, id_col: str = "id", text_col: str = "content_text") -> DataFrame:
    """(id, term, tf) of words and word pairs."""
    return _terms(df, id_col, text_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(docs: DataFrame, *, id_col: str = "id", text_col: str = "content_text", max_features: int | None = 60_000) -> tuple[DataFrame, DataFrame]:
    """Word and word-pair weights: (id, term, weight) with unit rows, and (term, idf) of the commonest terms (None: all). Term frequency is
    1 + ln, inverse document frequency ln((1 + n) / (1 + df)) + 1."""
    counted = count_terms(docs, id_col, text_col)
    n = docs.count()
    known = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all"))
    if max_features is not None:
        known = known.orderBy(F.desc("all"), "term").limit(max_features)
    idf = known.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return weigh(counted, idf, id_col), idf


def weigh(counted: DataFrame, idf: DataFrame, id_col: str = "id") -> DataFrame:
    raw = counted.join(idf, "term").select(id_col, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("x"))
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, id_col).select(id_col, "term", (F.col("x") / F.col("norm")).alias("weight"))


def route(queries: DataFrame, idf: DataFrame, index: DataFrame, labels: DataFrame, *, id_col: str = "id", text_col: str = "content_text", k: int = 5, frequent: int = 256) -> DataFrame:
    """(id, label, score, place): for each query the best labels by the cosine of their nearest row, ties to the smaller label.
    Queries meet rows by terms that at most ``frequent`` rows hold; see ``sparse.best_labels``."""
    asked = weigh(count_terms(queries, id_col, text_col), idf, id_col).withColumnRenamed(id_col, "id")
    held = index.select(F.col(id_col).alias("row"), "term", "weight")
    best = best_labels(asked, held, labels.select(F.col(id_col).alias("row"), "label"), k=k, frequent=frequent, row_norm=1.0)
    return best.withColumnRenamed("id", id_col)


def router_rows(documents: DataFrame, aliases: DataFrame, corrections: DataFrame, *, patterns: tuple[str, ...] = ("%s", "document about %s", "%s record")) -> DataFrame:
    """(text, label, origin) that a router is trained on: labelled documents (text, label), corrections (text, label), each
    label's name and aliases (local, alias) in fixed patterns."""
    names = aliases.select(F.col("local").alias("label"), F.replace("local", F.lit("-"), F.lit(" ")).alias("phrase")).union(aliases.select("local", "alias")).distinct()
    made = F.explode(F.array(*(F.format_string(p, "phrase") for p in patterns)))
    parts = [documents.select("text", "label", F.lit("document").alias("origin")), corrections.select("text", "label", F.lit("correction").alias("origin")), names.select(made.alias("text"), "label", F.lit("alias").alias("origin"))]
    return reduce(DataFrame.unionByName, parts).where("label is not null and trim(coalesce(text, '')) <> ''")


def retrain_gate(rows: DataFrame, last_count: int, *, least_rows: int, least_new: int, manual_since: Column) -> DataFrame:
    """One row: whether there are enough rows, and enough new ones or newer manual feedback."""
    agg = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("manual"), F.col("recorded_at"))).alias("manual_at"))
    new = F.col("rows") - last_count
    newer = F.coalesce(F.col("manual_at") > manual_since, F.lit(False))
    return agg.select("rows", new.alias("new_rows"), ((F.col("rows") >= least_rows) & ((new >= least_new) | newer)).alias("retrain"))


def updated_threshold(value: float, step: float = 0.02, least: float = 0.75) -> float:
    return max(least, value - step)
