"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracewell.queries import community, detection, evaluation, ledger, mail, organisation, parallel, pipeline, radar, scoring, site, text

SF = "/root/testdata/sf0.001"
FAMILIES = (scoring, radar, community, detection, organisation, evaluation, text, site, pipeline, mail, ledger, parallel)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(pd.Timestamp(v)) if "date" in type(v).__name__ or "Timestamp" in type(v).__name__ else str(v)

    return sorted("|".join(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


CASES = [(f, n) for f in FAMILIES for n in f.ORACLE]


@pytest.mark.parametrize(("family", "name"), CASES, ids=[n for _, n in CASES])
def test_matches_sql(spark, duck, family, name):
    got, want = family.QUERIES[name](spark, SF).toPandas(), duck.execute(family.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [x.replace(".0|", "|") for x in rows(got)] == [x.replace(".0|", "|") for x in rows(want)]


def test_queries_without_sql_run(spark):
    for f in FAMILIES:
        for name in set(f.QUERIES) - set(f.ORACLE):
            assert f.QUERIES[name](spark, SF).count() > 0, name
