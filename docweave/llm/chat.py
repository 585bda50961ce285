"""Chat formatting with quotation linking.

A message's lines are parsed into nested quote levels; successive lines of one level form a passage. Quoted passages are
normalised (white space squeezed, A-Z in lower case), hashed to 128 bits and joined to the messages that hold them as their own
words: the first such message of the same conversation, or else the first anywhere, if it comes before the quoting one. The
lowest, then first linked passage names the message replied to. Conversations tied by links form threads. Ids and turns are
taken to rise with time, and only earlier messages are replied to, so in the order of conversation and turn every message of a
thread follows what it replies to; quotes are taken out of the texts.

Own passages are reduced to their first holders before joining, by minima that combine before the shuffle, so a passage that
very many messages share never makes pairs.

Defined results: a null text is an empty message; a passage without letters or digits is linked with nothing; a passage found
nowhere earlier stays unlinked; rows with a null conversation or turn are not linked and their thread is their conversation;
repeated rows stay repeated; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import materialize, shielded
from docweave.llm.graph import components
from docweave.llm.mixing import with_running_sums

_QUOTED = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.DOTALL)
_SAYS = re.compile(r"^\s*(on\b.{0,200}\bwrote|.{0,80}\b(said|wrote|schrieb|a écrit|escribió)):?\s*$", re.IGNORECASE)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quote_levels(text: str) -> list[tuple[int, str]]:
    """(level, words) of each line; level 0 is the writer's own."""
    out = []
    for line in text.split("\n"):
        m = _QUOTED.fullmatch(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    return out


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(level, normalised words) of runs of one level; blank lines part them."""
    out: list[tuple[int, list[str]]] = []
    last = -1
    for level, words in lines:
        words = " ".join(words.split()).translate(_LOWER)
        if not words:
            last = -1
        elif level == last:
            out[-1][1].append(words)
        else:
            out.append((level, [words]))
            last = level
    return [(level, " ".join(words)) for level, words in out]


def own_words(lines: list[tuple[int, str]]) -> str:
    """The text without quotes and the lines that introduce them."""
    kept = [words for i, (level, words) in enumerate(lines) if not level and not (i + 1 < len(lines) and lines[i + 1][0] and _SAYS.match(words))]
    if len(kept) == len(lines):
        return "\n".join(kept)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def _key(words: str) -> str | None:
    return xxhash.xxh3_128_hexdigest(words) if any(c.isalnum() for c in words) else None


def parse(text: str) -> tuple[str, list[str], list[tuple[int, int, str]]]:
    """Own words, keys of own passages (and of all of them together), and (level, place, key) of quoted passages."""
    lines = quote_levels(text)
    found = passages(lines)
    mine = [words for level, words in found if not level]
    held = {_key(w) for w in mine} | {_key(" ".join(mine))}
    quoted = [(level, i, key) for i, (level, words) in enumerate(found) if level and (key := _key(words))]
    return own_words(lines), sorted(k for k in held if k), quoted


_QUOTES = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int32()), ("key", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [parse(t or "") for t in batch.column(0).to_pylist()]
        quotes = pa.array([[{"level": a, "place": b, "key": c} for a, b, c in d[2]] for d in done], _QUOTES)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string())), quotes], names=[*batch.schema.names[1:], "__own", "__held", "__quotes"])


@shielded(conv_col="conv_id", turn_col="turn", role_col="role", text_col="text")
def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``messages`` with quotes taken out of the text, n_quotes, n_linked, reply_conv and reply_turn (null: replies to nothing
    quoted), thread_id, position (from 1 in its thread, in reply order) and chat (role and words in chat form)."""
    own = {"n_quotes", "n_linked", "reply_conv", "reply_turn", "thread_id", "position", "chat"}
    columns = [c for c in messages.columns if c.lower() not in own]
    carried = [c for c in columns if c != text_col]
    quotes_type = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("key", T.StringType())]))
    schema = T.StructType([*(messages.schema[c] for c in carried), T.StructField("__own", T.StringType()), T.StructField("__held", T.ArrayType(T.StringType())), T.StructField("__quotes", quotes_type)])
    parsed = materialize(messages.select(text_col, *carried).mapInArrow(_parse, schema), "parsed-messages")
    at = F.struct(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"))
    placed = parsed.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(at.alias("at"), "__held", "__quotes")
    quotes = materialize(placed.select("at", F.explode("__quotes").alias("q")).select("at", "q.level", "q.place", "q.key").distinct(), "quotes")
    asked = quotes.select("key").distinct()
    held = placed.select("at", F.explode("__held").alias("key")).join(asked, "key", "left_semi")
    here = held.groupBy("key", F.col("at.conv").alias("conv")).agg(F.min("at").alias("here"))
    anywhere = held.groupBy("key").agg(F.min("at").alias("first"))
    found = quotes.withColumn("conv", F.col("at.conv")).join(here, ["key", "conv"], "left").join(anywhere, "key", "left")
    origin = F.when(F.col("here") < F.col("at"), F.col("here")).when(F.col("first") < F.col("at"), F.col("first"))
    found = found.select("at", "level", "place", origin.alias("origin"))
    best = F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "place", "origin")))
    replies = materialize(found.groupBy("at").agg(F.count("origin").alias("__linked"), best.alias("best")).select(F.col("at.conv").alias("__conv"), F.col("at.turn").alias("__turn"), "__linked", F.col("best.origin.conv").alias("reply_conv"), F.col("best.origin.turn").alias("reply_turn")), "replies")
    threads = components(replies.where("reply_conv <> __conv").select(F.col("__conv").alias("a"), F.col("reply_conv").alias("b")))
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    keyed = parsed.withColumns({"__c": conv, "__t": turn})
    linked = keyed.join(replies, (F.col("__c") == F.col("__conv")) & (F.col("__t") == F.col("__turn")), "left").join(threads, F.col("__c") == F.col("node"), "left")
    role = F.coalesce(F.col(role_col), F.lit("user"))
    out = linked.select(
        *(F.col("__own").alias(c) if c == text_col else F.col(c) for c in columns),
        F.size("__quotes").cast("long").alias("n_quotes"),
        F.coalesce("__linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv",
        "reply_turn",
        F.coalesce("component", "__c").alias("thread_id"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("__own"), F.lit("\n<|end|>")).alias("chat"),
    )
    # numbered over all threads at once, less the messages of threads before, so a very long thread is spread over tasks
    order = [F.col("thread_id").asc(), F.col(conv_col).asc(), F.col(turn_col).asc(), F.xxhash64("chat").asc()]
    ranked = with_running_sums(out, order, {"__place": F.lit(1)})
    counts = out.groupBy("thread_id").agg(F.count(F.lit(1)).alias("__rows"))
    before = with_running_sums(counts, [F.col("thread_id").asc()], {"__upto": F.col("__rows")}).select(F.col("thread_id").alias("__thread"), (F.col("__upto") - F.col("__rows")).alias("__before"))
    placed = ranked.join(before, F.col("thread_id").eqNullSafe(F.col("__thread")))
    return placed.select(*columns, "n_quotes", "n_linked", "reply_conv", "reply_turn", "thread_id", (F.col("__place") - F.col("__before")).cast("long").alias("position"), "chat")
