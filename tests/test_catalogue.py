"""Every catalogue query against its check statement on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of
from scorewright.plans.catalog import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert columns
    if name in oracle_sql():
        rel = duck.execute(oracle_sql()[name])
        want_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
        assert columns == want_columns
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_are_paired():
    assert set(oracle_sql()) <= set(queries())
