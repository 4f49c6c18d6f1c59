"""The SQL of the queries gives their rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from recurva.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
