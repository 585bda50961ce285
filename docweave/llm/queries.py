"""The queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.packing import about_pieces, pack_pieces, tokenize_pieces

    docs = table(spark, sf_dir, "documents")
    pieces = tokenize_pieces(docs, tokenizer("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = pack_pieces(pieces, n_rows=about_pieces(docs))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    "op6_quality_rules",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.quality import METRICS, STRICT, quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), **STRICT).select("doc_id", *METRICS, "base_failed", "kept")


@query(
    "op7_line_dedup",
    r"""
    with lines as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents
    ), keyed as (
        select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
    ), repeated as (
        select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
    ), marked as (
        select k.doc_id, k.line, k.pos, coalesce(k.doc_id > r.first, false) as gone from keyed k left join repeated r on k.key = r.key
    )
    select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
    from marked group by doc_id
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.lines import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op4_minhash_dedup",
)
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query(
    "op5_source_mixing",
)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query(
    "op9_suffix_dedup",
)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.repeats import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_chat_quotes",
)
def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.chat import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


#: The key of the registered query's pseudonyms. A deployment passes its own.
DEMO_KEY = b"docweave demonstration key"


@query(
    "op8_pii_pseudonyms",
)
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.pii import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)


@query(
    "op2_nearest_neighbours",
)
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.bestfit import pack_best_fit
    from docweave.llm.packing import tokenize_pieces

    window = 4096
    pieces = tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), window=window)
    cut = pieces.select("doc_id", (F.col("start") / window).cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_best_fit(cut, window=window)


@query(
    "op12_hard_negatives",
    """
    with whole as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
        from embeddings
        where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
        select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id, list_inner_product(a.v, r.v)::bigint as score
        from whole a join whole r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
    ), positives as (
        select anchor_id, vec_id as positive_id, score as positive_score from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
    ), ranked as (
        select p.*, s.vec_id as negative_id, s.score as negative_score,
               row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
        from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
         and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
    )
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.negatives import mine_hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(shifted, anchors=F.col("vec_id") % 100 == 0)


def _lloyd_sql(rounds: int = 3) -> str:
    nearest = """
        select vec_id, v, cluster, distance from (
            select r.vec_id, r.v, c.cluster, list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
            from whole r cross join {centroids} c
        ) qualify row_number() over (partition by vec_id order by distance, cluster) = 1"""
    steps = [
        """with whole as materialized (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), c0 as materialized (
            select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v from whole
            qualify cluster < 16
        )"""
    ]
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({nearest.format(centroids=f'c{r}')})")
        steps.append(
            f"""m{r} as (
            select cluster, list(((total - ((total % n) + n) % n) // n)::bigint order by i) as v from (
                select cluster, i, sum(x)::bigint as total, count(*) as n
                from (select cluster, unnest(v) as x, unnest(range(64)) as i from a{r}) group by cluster, i
            ) group by cluster
        ), c{r + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (cluster))"""
        )
    return (
        ", ".join(steps)
        + f""", last as materialized ({nearest.format(centroids=f'c{rounds}')})
        select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
               (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
        from last join (select cluster, v from c{rounds}) c using (cluster)"""
    )


@query("op13_centroid_clusters", _lloyd_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.llm.clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))
