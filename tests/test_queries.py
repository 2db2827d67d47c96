"""Each query against its SQL, or for rows alone where SQL has no word for it."""

import math
import os

import duckdb
import pytest

from pagewright.plans import registry
from tests.conftest import DATA_01

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.environ.get('QUERY_DATA', DATA_01)}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, os.environ.get("QUERY_DATA", DATA_01))
    got = rows(df.columns, df.collect())
    assert got, "a query has rows"
    if name in ORACLES:
        sql = duck.sql(ORACLES[name])
        assert sorted(sql.columns) == sorted(df.columns)
        want = rows(sql.columns, sql.fetchall())
        assert len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        assert not bad, bad[0]
