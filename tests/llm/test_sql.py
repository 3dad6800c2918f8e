"""Queries that SQL can express give what DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tracewell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, want.fetchall()))
