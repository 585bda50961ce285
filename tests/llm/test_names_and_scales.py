"""Extra columns named like the operators' own helpers, and neighbours at any scale."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import docweave.llm
from docweave.llm.chat import link_quotes
from docweave.llm.lines import dedup_lines
from docweave.llm.minhash import drop_near_duplicates
from docweave.llm.mixing import mixed_documents
from docweave.llm.neighbours import nearest
from docweave.llm.pii import pseudonymize
from docweave.llm.quality import quality_rules
from docweave.llm.repeats import remove_repeats
from docweave.session import ship
from tests.llm.conftest import DATA

#: Every name in quotes that the operators give to helper columns.
HELPERS = sorted({n for p in Path(docweave.llm.__file__).parent.glob("*.py") for n in re.findall(r'"((?:__|c\d_)\w+|id|row|raw|key|at|ranges|times|salt|place|part)"', p.read_text())} | {"c0_", "c1_"})
OPERATORS = {"dedup_lines": dedup_lines, "remove_repeats": remove_repeats, "quality_rules": quality_rules, "pseudonymize": lambda df: pseudonymize(df, b"k"), "mixed_documents": mixed_documents, "drop_near_duplicates": drop_near_duplicates}


def with_helpers(df, taken=()):
    extra = {n: F.lit(f"own {n}") for n in HELPERS if n not in taken}
    return df.select(*(F.lit(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in extra.items()), *df.columns), list(extra)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_named_like_helpers(spark, docs, name):
    few = docs.limit(60).cache()
    plain = OPERATORS[name](few)
    assert len(HELPERS) > 30
    loaded, extra = with_helpers(few)
    got = OPERATORS[name](loaded)
    columns = plain.columns
    assert set(got.columns) == set(columns) | set(extra)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, plain.collect()))
    assert {tuple(r) for r in got.select(*extra).collect()} <= {tuple(f"own {n}" for n in extra)}


def test_messages_with_columns_named_like_helpers(spark):
    talk = spark.read.parquet(f"{DATA}/conversations.parquet").limit(80).cache()
    loaded, extra = with_helpers(talk)
    plain = link_quotes(talk)
    got = link_quotes(loaded)
    assert set(got.columns) == set(plain.columns) | set(extra)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for df in (odd, none):
        rows, n_extra = df, len(df.columns)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, DATA)
            assert rows.columns == df.columns and len(rows.columns) == n_extra, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect() is not None


@pytest.fixture(scope="module")
def vectors(spark):
    ship(spark)
    return np.random.default_rng(9).normal(size=(600, 16))


def search(spark, x, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return nearest(df, queries=F.col("vec_id") % 20 == 0, k=k).collect()


def test_scales_change_nothing(spark, vectors):
    wanted = None
    for power in (0, 23, -498, 498):
        rows = search(spark, vectors * 2.0**power)
        found = {(r["query_id"], r["rank"]): r["vec_id"] for r in rows}
        assert len(found) == 30 * 20
        wanted = wanted or found
        assert found == wanted
        for r in rows[:50]:
            exact = float(vectors[r["query_id"]] @ vectors[r["vec_id"]]) * 2.0 ** (2 * power)
            assert r["score"] == pytest.approx(exact, rel=1e-9)
    assert len(search(spark, vectors * 1e7)) == 600


def test_tiny_and_huge_vectors_together(spark, vectors):
    x = vectors[:60].copy()
    x[3] *= 1e-200
    x[20] = [1e-200, *[0.0] * 15]
    x[7] *= 1e150
    rows = search(spark, x, k=5)
    assert len(rows) == 3 * 5
    for r in rows:
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), rel=1e-9)
    nothing_small = search(spark, np.array([[1e-320, 0.0], [5e-324, 0.0], [1.0, 1.0]]), k=5)
    assert len(nothing_small) == 2
