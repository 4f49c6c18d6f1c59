"""Every registered query against its SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from recurva import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for table in ("events", "embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_sql(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert name == "motif_occurrences_fixed" or rows
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert Counter(repr(tuple(r[c] for c in want.columns)) for r in rows) == Counter(map(repr, want.fetchall()))
