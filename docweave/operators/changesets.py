"""The file tree after a log of changes, and after restoring change sets.

The log (id, change_set, op, path, target) holds what was done: ``move`` takes what lies at ``path`` to ``target``, ``delete`` does the
same with ``target`` in a backup folder, ``create`` puts a new file at ``target``. Who lies where follows from the order of ids at each
path alone: an arrival's next entry at its path is the departure of the same file. So entries are linked to the next of their file by
one look ahead at each path, and chains of moves are followed by pointer jumping, in as many rounds as the logarithm of the longest
chain. A path that much of the log touches is cut into ranges of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docweave.functions.ranks import followed
from docweave.sources.shared import written


def last_changes(log: DataFrame, files: DataFrame) -> DataFrame:
    """(file, born, path, op, id, change_set, came_from) of each file of ``files`` (file, path) or created by the log: where it lies
    now, and the last entry that brought it there (nulls if none did). A created file is named by its entry's id (``born``)."""
    arrivals = log.select(F.col("target").alias("at"), F.col("id"), F.lit(False).alias("leaves"))
    departures = log.where("path is not null").select(F.col("path").alias("at"), "id", F.lit(True).alias("leaves"))
    starts = files.select(F.col("path").alias("at"), F.lit(-1).cast("long").alias("id"), F.lit(False).alias("leaves"))
    timeline = written(arrivals.unionByName(departures).unionByName(starts), "timeline")  # read three times
    # a departure and an arrival with one id are at different paths, as nothing moves to where it is
    seen = followed(timeline, "at", "id", ["id", "leaves"])
    next_of = written(seen.where("not leaves").select("at", "id", F.when(F.col("next.leaves"), F.col("next.id")).alias("next")), "next")
    entries = next_of.where("id >= 0").select("id", F.coalesce("next", "id").alias("to"))
    jumps = written(entries, "chains")
    while not jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").where("to <> further").isEmpty():
        further = jumps.select(F.col("id").alias("mid"), F.col("to").alias("far"))
        jumps = written(jumps.join(further, F.col("to") == F.col("mid")).select("id", F.col("far").alias("to")), "chains")
    firsts = files.select("file", F.col("path").alias("start")).join(next_of.where("id < 0").select(F.col("at").alias("start"), "next"), "start").select("file", F.lit(None).cast("long").alias("born"), "start", F.col("next").alias("first"))
    made = log.where("op = 'create'").select(F.lit(None).cast(files.schema["file"].dataType).alias("file"), F.col("id").alias("born"), F.col("target").alias("start"), F.col("id").alias("first"))
    ends = firsts.unionByName(made).join(jumps.select(F.col("id").alias("first"), "to"), "first", "left")
    entry = log.select(F.col("id").alias("to"), "change_set", "op", F.col("path").alias("came_from"), "target")
    return ends.join(entry, "to", "left").select("file", "born", F.coalesce("target", "start").alias("path"), "op", F.col("to").alias("id"), "change_set", "came_from")


def restored_tree(files: DataFrame, log: DataFrame, change_sets: DataFrame) -> DataFrame:
    """(file, born, path, state) after restoring the change sets (change_set). What a delete or move of such a set has last brought
    to where it lies goes back to the path it came from (``restored``), unless a live file lies there now or a later entry of the
    sets wants it too (``conflict``: it stays). Others are ``live`` or ``deleted``; entries whose files have been moved on since are
    left alone. A change set that is asked for twice counts once, an unknown one does nothing."""
    log = written(log, "log")  # read four times, however it is made
    now = written(last_changes(log, files), "tree")
    wanted = now.join(change_sets.select("change_set").distinct(), "change_set", "left_semi").where("op in ('delete', 'move')")
    first = F.row_number().over(Window.partitionBy("came_from").orderBy(F.desc("id"))) == 1
    live = now.where("op is null or op <> 'delete'").select(F.col("path").alias("came_from")).distinct().withColumn("taken", F.lit(True))
    tried = wanted.withColumn("first", first).join(live, "came_from", "left").select("id", (F.col("first") & F.col("taken").isNull()).alias("free"))
    both = now.join(tried, "id", "left")
    state = F.when(F.col("free"), "restored").when(F.col("free").isNotNull(), "conflict").when(F.col("op") == "delete", "deleted").otherwise("live")
    return both.select("file", "born", F.when(F.col("free"), F.col("came_from")).otherwise(F.col("path")).alias("path"), state.alias("state"))
