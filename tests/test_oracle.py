"""Every registered query with SQL equals its DuckDB oracle (small scale)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from attrix.sources.io import TEST_TABLES, table_path

from .conftest import SF_MID, SF_SMALL

# queries whose defined input size exceeds the smallest scale (pool of 1,000)
NEEDS_MID = {"spl_2_retraining_pool", "job_4_base_and_pool"}


def _norm(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif hasattr(v, "item"):
                v = v.item()
                row.append(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                row.append(round(float(v), 6))
            else:
                row.append(v)
        out.append(tuple(row))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    cons = {}
    for sf in (SF_SMALL, SF_MID):
        con = duckdb.connect()
        for t in TEST_TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
        cons[sf] = con
    return cons


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sf = SF_MID if name in NEEDS_MID else SF_SMALL
    got = E.queries()[name](spark, sf).toPandas()
    want = duck[sf].sql(E.oracle_sql()[name]).df()
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "churn_rate" in df.columns


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    assert len(qs) >= 130
