"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tracewright.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(D):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{t}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want and got


def test_plans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["yaw_offset"](spark, D)._jdf.queryExecution().toString()
    assert "l_orderkey" not in plan.split("ReadSchema:")[1].split("\n")[0]
