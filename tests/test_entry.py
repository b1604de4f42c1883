"""The entry module: every query with SQL gives DuckDB's rows, and the optional subpackage is not needed."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def shown(value):
    return None if value is None else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.library.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, str(DATA))
    got = [tuple((c, shown(r[c])) for c in sorted(df.columns)) for r in df.collect()]
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = [tuple(sorted(((c, shown(v)) for c, v in zip(names, row, strict=True)), key=lambda x: x[0])) for row in result.fetchall()]
    key = lambda row: [(c, v is not None, v or "") for c, v in row]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["left_id", "right_id", "score"]


def test_library_stands_alone(tmp_path):
    for part in ("blockprint", "__spark_entry__.py"):
        source = ROOT / part
        shutil.copytree(source, tmp_path / part) if source.is_dir() else shutil.copy(source, tmp_path / part)
    shutil.rmtree(tmp_path / "blockprint" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'clusters' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_only_the_entry_module_knows_the_subpackage():
    for f in (ROOT / "blockprint").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "blockprint").parts:
            assert "blockprint.llm" not in f.read_text(), f
