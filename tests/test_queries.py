"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from quorumlake import plans

DIR = "/root/testdata/sf0.001"


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(float(v), 3) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, DIR)
    got = df.collect()
    if sql := plans.oracle_sql().get(name):
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        order = sorted(df.columns)
        pick = lambda columns, rows: [[r[columns.index(c)] for c in order] for r in rows]
        assert plain(pick(df.columns, got)) == plain(pick(want.columns, want.fetchall()))
