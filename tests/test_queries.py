"""Every core query against its SQL in DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from millrace.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as from '{p}'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([row[i] if not isinstance(row[i], datetime.datetime) else row[i].replace(tzinfo=None) for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(sql.columns, sql.fetchall())
