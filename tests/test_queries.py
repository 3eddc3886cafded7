"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tablewright.plans import base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    assert not isinstance(value, decimal.Decimal)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, sf, duck, name):
    df = base.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in base.ORACLE:
        want = duck.sql(base.ORACLE[name])
        assert sorted(want.columns) == columns
        kinds = dict(zip(want.columns, map(str, want.types), strict=True))
        assert {c: TYPES[dict(df.dtypes)[c]] for c in columns} == {c: kinds[c] for c in columns}
        at = [want.columns.index(c) for c in columns]
        assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(base.QUERIES) <= set(entry.queries())
