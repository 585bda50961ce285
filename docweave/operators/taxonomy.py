"""External taxonomies: labels, aliases, matching by phrases."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.operators.sparse import best_labels, best_of_few
from docweave.session import ship


def phrase(text: Column) -> Column:
    """A phrase in lower case: ``&`` as and, all but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def csv_last_column(lines: DataFrame) -> DataFrame:
    """Labels from the last column of CSV lines (value). Quoted fields may hold commas; a doubled quote in them is one."""
    last = F.trim(F.regexp_extract("value", r'(?s)(?:^|,)("(?:[^"]|"")*"|[^,"]*)\s*$', 1))
    plain = F.when(last.startswith('"'), F.replace(F.regexp_replace(last, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(last)
    return lines.select(F.trim(plain).alias("label")).where("label <> ''")


def breadcrumb_labels(lines: DataFrame, depth: int = 2) -> DataFrame:
    """Labels from lines like ``A > B > C``: the last part, and the last ``depth`` parts together."""
    parts = F.filter(F.transform(F.split("value", ">"), lambda v: F.trim(v)), lambda p: p != "")
    rows = lines.select(parts.alias("parts")).where("size(parts) > 0")
    return rows.select(F.element_at("parts", -1).alias("label"), F.array_join(F.slice("parts", F.greatest(F.lit(1), F.size("parts") - depth + 1), depth), " > ").alias("tail"))


def tiered_labels(lines: DataFrame, tiers: int = 4) -> DataFrame:
    """Labels from TSV lines whose last ``tiers`` columns are tiers; the deepest that is filled counts."""
    cells = F.split("value", "\t")
    filled = F.filter(F.slice(cells, F.greatest(F.lit(1), F.size(cells) - tiers + 1), tiers), lambda c: F.trim(c) != "")
    return lines.select(F.trim(F.element_at(filled, -1)).alias("label")).where("label is not null and label <> ''")


def map_to_local(external: DataFrame, local: DataFrame) -> DataFrame:
    """External labels (label) to local ones (local, keyword): by equal phrases, or else by the keyword's phrase inside. Word
    n-grams of the external phrase are joined to keywords, so no pair is tried that shares none."""
    ext = external.select("label", phrase(F.col("label")).alias("p")).where("p <> ''").distinct()
    words = F.split("p", " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    keys = local.select("local", phrase(F.col("keyword")).alias("k")).where("k <> ''").distinct()
    found = ext.select("label", "p", F.explode(F.array_distinct(grams)).alias("k")).join(keys, "k")
    exact = F.max((F.col("p") == F.col("k")).cast("int"))
    best = found.groupBy("label").agg(exact.alias("exact"))
    return found.join(best, "label").where("exact = 0 or p = k").select("label", "local").distinct()


def allowed_alias(alias: Column, blocked: list[str], least: int = 3) -> Column:
    return (F.length(alias) >= least) & ~alias.isin(blocked) & ~alias.rlike("^[0-9 ]+$")


def build_aliases(mapped: DataFrame, *, blocked: list[str] | None = None, blocked_by_label: dict[str, list[str]] | None = None, most: int = 120) -> DataFrame:
    """(local, alias): phrases of the external labels of each local one, at most ``most`` of them by order of the alphabet."""
    rows = mapped.select("local", phrase(F.col("label")).alias("alias")).distinct().where(allowed_alias(F.col("alias"), blocked or []))
    for label, gone in (blocked_by_label or {}).items():
        rows = rows.where(~((F.col("local") == label) & F.col("alias").isin(gone)))
    place = F.row_number().over(Window.partitionBy("local").orderBy("alias"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


_automata: dict[str, object] = {}  # the one this worker has built, by the token of its aliases


def _held_aliases(aliases: Broadcast, token: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, aliases) of the aliases that each phrase holds as whole words, found in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automata.get(token)
        if automaton is None:
            _automata.clear()
            automaton = ahocorasick.Automaton()
            for alias in aliases.value:
                automaton.add_word(f" {alias} ", alias)
            automaton.make_automaton()
            _automata[token] = automaton
        for batch in batches:
            found = [sorted({alias for _, alias in automaton.iter(f" {p} ")}) for p in batch.column(1).to_pylist()]
            kept = [i for i, own in enumerate(found) if own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([found[i] for i in kept], pa.list_(pa.string()))], names=["id", "aliases"])

    return run


def match_aliases(docs: DataFrame, aliases: DataFrame, *, id_col: str = "id", text_col: str = "content_text", limit: int = 6, chunk_bytes: int = 16 << 20) -> DataFrame:
    """(id, label, score, evidence, place): labels whose aliases a text holds as whole words. A hit gives 2 points and one for
    each word up to three. The aliases are built into automata of at most about ``chunk_bytes`` of aliases, dealt by hash; each is
    broadcast and finds all its aliases in one pass over the texts."""
    spark = docs.sparkSession
    ship(spark)
    keys = aliases.select(F.col("local").alias("label"), "alias").where("alias <> ''").distinct()
    names = keys.select("alias").distinct()
    total = names.agg(F.coalesce(F.sum(F.length("alias") + 2), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_bytes))
    phrases = docs.select(F.col(id_col).alias("id"), phrase(F.col(text_col)).alias("phrase"))  # no filter: it would make phrases twice
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, aliases array<string>"
    parts = []
    for chunk in range(chunks):
        own = names.where(F.pmod(F.xxhash64("alias"), F.lit(chunks)) == chunk) if chunks > 1 else names
        held = [r["alias"] for r in own.collect()]  # a chunk
        if held:
            parts.append(phrases.mapInArrow(_held_aliases(spark.sparkContext.broadcast(held), uuid.uuid4().hex), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    points = 2 + F.least(F.size(F.split("alias", " ")), F.lit(3))
    hits = found.select(F.col("id").alias(id_col), F.explode("aliases").alias("alias")).join(keys, "alias").withColumn("points", points)
    scored = hits.groupBy(id_col, "label").agg(F.sum("points").alias("score"), F.slice(F.sort_array(F.collect_set("alias")), 1, 4).alias("evidence"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "label"))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def hint_text(matches: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels and evidence of each document in order of rank, each once."""
    listed = F.sort_array(F.collect_list(F.struct("place", "label", "evidence")))
    grouped = matches.groupBy(id_col).agg(listed.alias("m"))
    return grouped.select(id_col, F.array_join(F.array_distinct(F.flatten(F.transform("m", lambda m: F.concat(F.array(m["label"]), m["evidence"])))), " ").alias("hint"))


def candidate_categories(external: Column, router: Column, groups: Column, allowed: list[str], most: int = 12) -> Column:
    """Ordered union of matched, routed and grouped labels within the allowed ones, then unknown and needs-review."""
    first = F.array_intersect(F.array_distinct(F.concat(external, router, groups)), F.array(*map(F.lit, allowed)))
    return F.slice(F.array_distinct(F.concat(first, F.array(F.lit("unknown"), F.lit("needs-review")))), 1, most)


def similar_examples(docs: DataFrame, examples: DataFrame, *, id_col: str = "id", k: int = 3, frequent: int = 256) -> DataFrame:
    """Examples (eid, words) that share most words with each document (id, words), the best k, ties to the smaller eid. Words that
    more than ``frequent`` examples hold bring nobody together; see ``sparse.best_labels``. A bounded number of examples is broadcast
    instead, so that words of all documents don't meet in one task. Ids are unique."""
    terms = examples.select(F.col("eid").alias("row"), F.explode(F.array_distinct("words")).alias("term"))
    found = best_of_few(docs.select(F.col(id_col).alias("id"), F.array_distinct("words").alias("terms")), terms, examples.select(F.col("eid").alias("row"), F.col("eid").alias("label")).distinct(), k=k)
    if found is not None:
        return found.select(F.col("id").alias(id_col), F.col("label").alias("eid"), F.col("score").alias("n"), "place")
    one = F.lit(1.0).alias("weight")
    asked = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct("words")).alias("term"), one)
    held = examples.select(F.col("eid").alias("row"), F.explode(F.array_distinct("words")).alias("term"), one)
    best = best_labels(asked, held, examples.select(F.col("eid").alias("row"), F.col("eid").alias("label")), k=k, frequent=frequent)
    return best.select(F.col("id").alias(id_col), F.col("label").alias("eid"), F.col("score").cast("long").alias("n"), "place")
