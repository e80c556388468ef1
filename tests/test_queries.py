"""Every query with a stated SQL equals it on the smallest tables, value for value."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from cuewright import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert rows
    if name in catalog.ORACLE:
        found = oracle.sql(catalog.ORACLE[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        want = sorted(([plain(r[k]) for k in order] for r in found.fetchall()), key=repr)
        assert len(rows) == len(want)
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9)) for x, y in zip(rows, want) for a, b in zip(x, y))
