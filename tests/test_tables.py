"""Versioned tables, trees after change sets, and unique names, against plain versions."""

from __future__ import annotations

import os

import numpy as np
import pytest

from docweave.functions.ranks import followed
from docweave.operators.changesets import restored_tree
from docweave.operators.reconcile import sequence_of_names
from docweave.sources.tables import VersionedTable, VersionTaken

SCHEMA = "id long, name string, seq long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", 8, SCHEMA)
    assert table.read().collect() == [] and table.versions() == []
    first = [(i, f"n{i}", 0) for i in range(40)] + [(None, "none", 0)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA), batch="b1") == 1
    before, old = files_of(tmp_path), table.manifest()["places"]
    change = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (100, "more", 0), (None, "again", 0)], SCHEMA)
    assert table.upsert(change, latest="seq", batch="b2") == 2
    wanted = {r[0]: r for r in first} | {3: (3, "new", 2), 100: (100, "more", 0), None: (None, "again", 0)}
    assert rows_of(table.read()) == sorted(wanted.values(), key=str)
    assert rows_of(table.read(1)) == sorted(first, key=str)
    new = table.manifest()["places"]
    assert before < files_of(tmp_path) and 1 <= sum(new[b] != old.get(b) for b in new) <= 3
    assert table.upsert(change, latest="seq", batch="b2") == 2  # run again
    assert table.upsert(change.limit(0)) == 2
    assert table.vacuum(keep=1) > 0 and table.versions() == [2] and rows_of(table.read()) == sorted(wanted.values(), key=str)


def test_a_failed_upsert_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id", 4, SCHEMA)
    table.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    change = spark.createDataFrame([(1, "b", 0), (2, "c", 0)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda self, manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.upsert(change)
    assert rows_of(table.read()) == [(1, "a", 0)]
    stale = table.manifest()
    table.upsert(change)
    with monkeypatch.context() as m:  # another writer read the version before
        m.setattr(VersionedTable, "manifest", lambda self, version=None: stale)
        with pytest.raises(VersionTaken):
            table.upsert(spark.createDataFrame([(1, "z", 0)], SCHEMA))
    assert rows_of(table.read()) == [(1, "b", 0), (2, "c", 0)]


def random_log(seed, n_files, n_entries):
    """A log made by replaying it, so that it holds together; live paths are few, so they are taken again."""
    rng = np.random.default_rng(seed)
    at = {f: f"/p{f}" for f in range(n_files)}
    log, made = [], 0
    for i in range(n_entries):
        taken = set(at.values())
        kind = rng.choice(["move", "delete", "create"], p=[0.6, 0.25, 0.15])
        free = [p for p in (f"/p{k}" for k in range(n_files + 3)) if p not in taken]
        if kind == "create":
            if free:
                target = str(rng.choice(free))
                made += 1
                at[("new", i)] = target
                log.append((i, f"cs{i % 5}", "create", None, target))
            continue
        who = list(at)[int(rng.integers(0, len(at)))]
        target = f"/_backup/{i}" if kind == "delete" or not free else str(rng.choice(free))
        op = "delete" if target.startswith("/_backup") else "move"
        log.append((i, f"cs{i % 5}", op, at[who], target))
        at[who] = target
    return log


def plain_tree(files, log, wanted):
    where, last = dict(files), {}
    for i, cs, op, path, target in log:
        who = ("new", i) if op == "create" else next(f for f, p in where.items() if p == path)
        where[who], last[who] = target, (i, cs, op, path)
    gone = {f for f, x in last.items() if x[2] == "delete"}
    live = {p for f, p in where.items() if f not in gone}
    asked = sorted((x[0], f) for f, x in last.items() if x[1] in wanted and x[2] in ("delete", "move"))
    out = {f: (p, "deleted" if f in gone else "live") for f, p in where.items()}
    claimed = set()
    for _, f in reversed(asked):
        back = last[f][3]
        if back in live or back in claimed:
            out[f] = (where[f], "conflict")
        else:
            out[f] = (back, "restored")
        claimed.add(back)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_after_restoring(spark, seed):
    files = [(f, f"/p{f}") for f in range(12)]
    log = random_log(seed, 12, 150)
    wanted = ["cs1", "cs3", "cs3", "unknown"]
    frame = spark.createDataFrame(log, "id long, change_set string, op string, path string, target string").repartition(3)
    tree = restored_tree(spark.createDataFrame(files, "file long, path string"), frame, spark.createDataFrame([(w,) for w in wanted], "change_set string"))
    got = {r["file"] if r["born"] is None else ("new", r["born"]): (r["path"], r["state"]) for r in tree.collect()}
    assert got == plain_tree(files, log, wanted)
    assert {s for _, s in got.values()} >= {"live", "deleted", "restored"}


def test_tree_without_a_log(spark):
    files = spark.createDataFrame([(1, "/a"), (2, None)], "file long, path string")
    log = spark.createDataFrame([], "id long, change_set string, op string, path string, target string")
    assert rows_of(restored_tree(files.where("path is not null"), log, log.select("change_set"))) == [(1, None, "/a", "live")]


def test_followed_over_ranges(spark):
    rows = spark.createDataFrame([(None if i % 11 == 0 else i % 3, i) for i in range(200)], "g long, i long")
    got = {r["i"]: r["next"] and r["next"]["i"] for r in followed(rows, "g", "i", ["i"], parts=7).collect()}
    own = {}
    for g, i in rows.collect():
        own.setdefault(g, []).append(i)
    assert got == {i: (own[g][k + 1] if k + 1 < len(own[g]) else None) for g in own for k, i in enumerate(own[g])}


def plain_names(rows, existing):
    held, out = set(existing), {}
    own = {}
    for i, n in sorted(rows):
        own.setdefault(n, i)
    reserved = held | set(own)
    for i, n in sorted(rows):
        if own[n] == i and n not in held:
            out[i] = n
    for i, n in sorted(rows):
        if i not in out:
            stem, ext = os.path.splitext(n)
            k = 2
            while f"{stem} ({k}){ext}" in reserved:
                k += 1
            out[i] = f"{stem} ({k}){ext}"
            reserved.add(out[i])
    return out


def test_unique_names_never_repeat(spark):
    rng = np.random.default_rng(3)
    names = ["a.txt", "a (2).txt", "a (4).txt", "a (2) (2).txt", ".rc", ".rc (2)", "b", "b (3)", "a.b.c", "x.", "..", "a (02).txt", "a (7).txt", "a (12).txt"]
    rows = [(i, str(rng.choice(names, p=[0.3, *[0.7 / 13] * 13]))) for i in range(300)]
    existing = ["a.txt", "a (5).txt", "a (6).txt", "b (2)", "other"]
    df = spark.createDataFrame(rows, "id long, name string").repartition(3)
    for known in (existing, []):
        frame = spark.createDataFrame([(n,) for n in known], "name string")
        got = {r["id"]: r["unique_name"] for r in sequence_of_names(df, frame, block=16).collect()}
        assert len(set(got.values())) == 300 and not set(got.values()) & set(known)
        assert got == plain_names(rows, known)
    assert {r["id"]: r["unique_name"] for r in sequence_of_names(df).collect()} == got
