"""Every query that SQL can express, against DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from marlstone import queries, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return "" if v is None else str(v) if not isinstance(v, datetime.date) else v.isoformat()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    twin = duck.sql(sql.SQL[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_registry(spark):
    assert set(sql.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
