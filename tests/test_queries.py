"""Every registered query against its SQL twin on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, rows_of
from workload import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rel.fetchall())


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0
