"""Every engine query against its SQL in DuckDB, over the smallest tables."""

import datetime as dt
import os
from collections import Counter

import pytest

from rillflow import live_queries, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


ALL = queries.QUERIES | live_queries.QUERIES


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    got = ALL[name](spark, SF)
    want = duck.execute((queries.ORACLES | live_queries.ORACLES)[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
