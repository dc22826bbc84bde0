"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from newsloom.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
#: Queries that this small a table may have nothing for.
MAY_BE_EMPTY = {"ttl_snapshot", "explore_page"}


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)

    def plain(df):
        rows = df[columns].astype(object).where(df[columns].notna(), None).map(lambda v: repr(float(v)) if isinstance(v, float) else str(v))
        return sorted(map(tuple, rows.values.tolist()))

    assert plain(left) == plain(right)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    same(got, duck.execute(SQL[name]).df())
    assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
