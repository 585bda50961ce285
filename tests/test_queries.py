"""Every registered query of the engine against its DuckDB equivalent on the smallest tables."""

from __future__ import annotations

import pytest

from docweave.plans import queries
from tests.conftest import DATA
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, DATA))
    if name in queries.ORACLES:
        want_names, want = duck_rows(queries.ORACLES[name], DATA)
        assert names == want_names
        assert rows == want
