"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

1. Sizes in words are summed by source. Sources, by code point and null last, take the weights in turn and share the total;
   a source's target stops at a multiple of its size and the excess is shared again (water filling in one sorted pass).
2. Each source's documents are dealt by a seeded hash into shards of bounded size, and each shard is a stream of words in a
   seeded order, cut into equal blocks.
3. Blocks are seats. Sources get them by the highest quotients votes / (2 k + 1); shards get their source's seats in the same
   way. Only quotients that can decide (about three a party) are made and ranked.
4. A shard with q seats and m blocks takes every block q div m times, and one time more q mod m blocks drawn by a seeded
   systematic sample. What a document gives follows in closed form from its place in the stream.

A source's words come within about half a block a shard of its target. Defined results: a null text has size 0 and gives
nothing; a null source is a source of its own; equal rows are interchangeable; an empty table gives an empty result; columns
other than id, source and text don't matter. Reruns agree: every draw is a hash of ids and the seed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.llm.common import WORD, materialize, shielded

_KEY = ["__null", "__source"]
#: A share of 1 in whole units.
_UNIT = 1 << 30


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds sums over all rows up to and including each in a total order, without bringing all rows into one task: rows are
    range partitioned, and only one row a partition is summed across partitions."""
    values = {f"__v_{name}": value for name, value in sums.items()}
    ranged = materialize(df.withColumns(values).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"{v}_t") for v in values))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"{v}_t").over(before), F.lit(0)).alias(f"{v}_o") for v in values))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(offsets, "__part")
    return joined.select(*df.columns, *((F.col(f"__v_{name}_o") + F.sum(f"__v_{name}").over(within)).alias(name) for name in sums))


def source_targets(sources: DataFrame, *, weights: tuple[float, ...], percent: float, most: float) -> DataFrame:
    """Adds the target of each source (__null, __source, source_size)."""
    order = [F.col("__null").asc(), F.col("__source").asc()]
    ranked = with_running_sums(sources, order, {"__rank": F.lit(1)})
    turn = F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int")
    weighed = ranked.withColumn("__weight", F.array(*(F.lit(float(w)) for w in weights))[turn]).withColumn("__cap", most * F.col("source_size"))
    weighed = materialize(weighed.withColumn("__level", F.col("__cap") / F.col("__weight")), "weights")
    all_size, all_weight, all_cap = weighed.agg(F.sum("source_size"), F.sum("__weight"), F.sum("__cap")).first()
    if not all_size:
        return weighed.withColumn("target", F.lit(0.0))
    total = min(all_size * percent / 100, all_cap)
    filled = with_running_sums(weighed, [F.col("__level").asc(), *order], {"__caps": F.col("__cap"), "__weights": F.col("__weight")})
    # a source is full if raising all to its level takes no more than the total
    full = F.col("__caps") + F.col("__level") * (all_weight - F.col("__weights")) <= total
    filled = materialize(filled.withColumn("__full", full), "filled")
    taken, left = filled.agg(F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)), F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__weight")))).first()
    level = (total - taken) / left if left else 0.0
    return filled.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.lit(level) * F.col("__weight"))))


def _deciding(parties: DataFrame) -> DataFrame:
    """Adds to parties (__votes, __most seats each may have, __all votes, __n parties and __seats of their contest) the seats
    __sure that each has in any case, and a row for each further seat __k that may be won, with its __quotient."""
    quota = F.col("__votes") * F.col("__seats") / F.col("__all")
    spread = F.col("__n") / (2.0 * F.col("__seats"))
    contest = F.when((F.col("__seats") > 0) & (F.col("__all") > 0), F.lit(True)).otherwise(False)
    sure = F.when(contest, F.greatest(F.lit(0), F.least("__most", F.floor(quota * (1 - spread) - 0.5)))).otherwise(0).cast("long")
    last = F.when(contest, F.least("__most", F.ceil(quota * (1 + spread) + 0.5) + 1)).otherwise(0).cast("long")
    return parties.withColumn("__sure", sure).withColumn("__last", last)


def _seat_rows(parties: DataFrame) -> DataFrame:
    rows = parties.where("__last > __sure").withColumn("__k", F.explode(F.sequence("__sure", F.col("__last") - 1)))
    return rows.withColumn("__quotient", F.col("__votes") / (2 * F.col("__k") + 1))


def apportion_sources(sources: DataFrame) -> DataFrame:
    """Seats of each source (__quota): votes are its target in blocks; there are as many seats as votes, rounded."""
    voted = sources.withColumn("__votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("__blocks") / F.col("source_size")).otherwise(0.0))
    total, n = voted.agg(F.sum("__votes"), F.count(F.lit(1))).first()
    seats = round(total or 0)
    parties = materialize(_deciding(voted.withColumns({"__all": F.lit(float(total or 0)), "__n": F.lit(n), "__seats": F.lit(seats)})), "parties")
    sure = parties.agg(F.sum("__sure")).first()[0] or 0
    order = [F.col("__quotient").desc(), F.col("__null").asc(), F.col("__source").asc(), F.col("__k").asc()]
    won = with_running_sums(_seat_rows(parties).select(*_KEY, "__k", "__quotient"), order, {"__place": F.lit(1)}).where(F.col("__place") <= seats - sure)
    more = won.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__won"))
    return parties.join(more, _KEY, "left").select(*_KEY, "source_size", "target", "__blocks", (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("__quota"))


def apportion_shards(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """Seats of each shard (__seats_won): its source's quota by blocks."""
    contest = sources.select(*_KEY, F.col("__quota").alias("__seats"), F.col("__blocks").cast("double").alias("__all"), F.col("__shards").alias("__n"))
    parties = shards.join(contest, _KEY).withColumn("__votes", F.col("__m").cast("double")).withColumn("__most", 2 * F.col("__m"))
    parties = materialize(_deciding(parties), "shard-parties")
    sure = parties.groupBy(*_KEY).agg(F.sum("__sure").alias("__all_sure"))
    seats = _seat_rows(parties).select(*_KEY, "__shard", "__k", "__quotient", "__seats")
    ahead = [F.col("__null").asc(), F.col("__source").asc()]
    # ranked over all sources at once, so a source with very many shards is spread over tasks; less the rows of sources before
    ranked = with_running_sums(seats, [*ahead, F.col("__quotient").desc(), F.col("__k").asc(), F.col("__shard").asc()], {"__place": F.lit(1)})
    counts = seats.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__rows"))
    before = with_running_sums(counts, ahead, {"__upto": F.col("__rows")}).select(*_KEY, (F.col("__upto") - F.col("__rows")).alias("__before"))
    rows = ranked.join(before, _KEY).join(sure, _KEY).where("__place - __before <= __seats - __all_sure")
    more = rows.groupBy(*_KEY, "__shard").agg(F.count(F.lit(1)).alias("__won"))
    return parties.join(more, [*_KEY, "__shard"], "left").select(*_KEY, "__shard", "__s", "__m", "__b", (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("__q"))


def _placed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    percent: float = 150,
    most: float = 2,
    block_words: int = 64,
    docs_per_shard: int = 256,
    seed: int = 20,
) -> DataFrame:
    """__id, __null, __source, __text (hash of the text), size, source_size, target and taken of each row."""
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).alias("__id"), F.col(source_col).isNull().alias("__null"), F.coalesce(source_col, F.lit("")).alias("__source"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__text"), size.alias("size")), "sizes")
    per_source = sizes.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / docs_per_shard).cast("long").alias("__shards"))
    per_source = materialize(per_source, "sources")
    shard = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.col("__shards"))
    dealt = sizes.join(per_source.select(*_KEY, "__shards"), _KEY).select("__id", *_KEY, "__text", "size", shard.alias("__shard"))
    shards = dealt.groupBy(*_KEY, "__shard").agg(F.sum("size").alias("__s"))
    about = F.greatest(F.lit(1.0), F.round(F.col("__s") / block_words))
    shards = shards.withColumn("__b", F.greatest(F.lit(1), F.ceil(F.col("__s") / about)).cast("long")).withColumn("__m", F.ceil(F.col("__s") / F.col("__b")).cast("long"))
    shards = materialize(shards, "shards")
    targets = source_targets(per_source.select(*_KEY, "source_size"), weights=weights, percent=percent, most=most)
    blocks = shards.groupBy(*_KEY).agg(F.sum("__m").alias("__blocks"))
    parties = targets.select(*_KEY, "source_size", "target").join(blocks, _KEY).withColumn("__most", (most * F.col("__blocks")).cast("long"))
    quotas = materialize(apportion_sources(parties).join(per_source.select(*_KEY, "__shards"), _KEY), "quotas")
    won = apportion_shards(shards, quotas)
    # one row a shard, with what is needed to place its documents
    plan = won.join(quotas.select(*_KEY, "source_size", "target"), _KEY)
    own = Window.partitionBy(*_KEY, "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "__id"), "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("__end", F.sum("size").over(own)).join(plan, [*_KEY, "__shard"])
    placed = placed.selectExpr("*", "__q div greatest(__m, 1) as __times", "__q % greatest(__m, 1) as __extra", f"pmod(xxhash64({seed + 2}, __source, __null, __shard), greatest(__m, 1)) as __turn")

    def chosen_before(k: str) -> str:
        """Of the first k blocks, how many the systematic sample draws; it begins at block number __turn of the circle."""
        after = f"({k} + __turn)"
        return f"(case when {after} <= __m then {after} * __extra div greatest(__m, 1) else __extra + ({after} - __m) * __extra div greatest(__m, 1) end - __turn * __extra div greatest(__m, 1))"

    def words_before(p: str) -> str:
        block = f"least({p} div __b, greatest(__m, 1) - 1)"
        here = f"({chosen_before(f'({block} + 1)')} - {chosen_before(block)})"
        return f"(__b * {chosen_before(block)} + {here} * ({p} - {block} * __b))"

    taken = f"cast(__times * size + {words_before('__end')} - {words_before('(__end - size)')} as long)"
    return placed.selectExpr("__id", *_KEY, "__text", "size", "source_size", "target", f"{taken} as taken")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """id_col, size, source_size, target and taken of each row: how many words of each document the mix takes."""
    return _placed(docs, id_col=id_col, **options).select(F.col("__id").alias(id_col), "size", "source_size", "target", "taken")


@shielded(id_col="doc_id", source_col="source", text_col="text")
def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 20, **options: object) -> DataFrame:
    """``docs`` with each document left out, once or repeated, so that each source keeps the words that the mix takes of it.

    Shares taken / size are summed in the order of source and size, and a document's copies are the whole numbers its share
    passes: what rounding leaves is carried on. Sizes rise within a source, so its words are off by its largest document at most.
    """
    placed = _placed(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options).where("size > 0")
    # in whole units, so that the sums don't depend on the order of additions
    share = F.expr(f"taken * {_UNIT} div size")
    order = [F.col("__null").asc(), F.col("__source").asc(), F.col("size").asc(), F.xxhash64(F.lit(seed + 3), "__id", "__text").asc(), F.col("__id").asc(), F.col("taken").asc()]
    summed = with_running_sums(placed.withColumn("__share", share), order, {"__upto": F.col("__share")})
    times = F.expr(f"(__upto + {_UNIT // 2}) div {_UNIT} - (__upto - __share + {_UNIT // 2}) div {_UNIT}")
    # rows with equal ids, sources and texts share their copies evenly
    keys = ["__m_id", "__m_null", "__m_source", "__m_text"]
    named = summed.select(F.col("__id").alias("__m_id"), F.col("__null").alias("__m_null"), F.col("__source").alias("__m_source"), F.col("__text").alias("__m_text"), times.alias("__times"))
    often = named.groupBy(*keys).agg(F.sum("__times").alias("__often"), F.count(F.lit(1)).alias("__rows")).where("__often > 0")
    own = (F.col(id_col), F.col(source_col).isNull(), F.coalesce(source_col, F.lit("")), F.xxhash64(F.coalesce(text_col, F.lit(""))))
    joined = docs.join(often, reduce(lambda a, b: a & b, (mine.eqNullSafe(F.col(k)) for mine, k in zip(own, keys, strict=True))))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    copies = F.expr("cast(__often div __rows as int)") + F.when(F.col("__place") <= F.col("__often") % F.col("__rows"), 1).otherwise(0)
    dealt = joined.withColumn("__place", place).withColumn("__copies", copies).where("__copies > 0")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
