"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry
from check_oracle import rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, TEXTS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_every_text_has_a_query():
    assert set(TEXTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in TEXTS:
        cursor = duck.execute(TEXTS[name])
        assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_flagship(spark):
    assert registry.entry(spark).count() == 10
