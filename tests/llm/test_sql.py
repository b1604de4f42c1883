"""Queries with SQL give DuckDB's rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from blockprint.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = queries.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    shown = lambda row: tuple("" if v is None else str(v) for v in row)
    assert sorted(shown([r[c] for c in names]) for r in df.collect()) == sorted(map(shown, result.fetchall()))
