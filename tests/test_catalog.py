"""Every query of the catalogue against its SQL on the smallest given tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
# The queries of the added package have tests of their own.
QUERIES, SQL = spark_entry.CATALOG, spark_entry.ORACLE
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no given tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA), sql.sql(SQL[name])
    assert {k: TYPES[t] for k, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.toPandas()) == rows(want.df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_learned_query_runs(spark, name):
    frame = QUERIES[name](spark, DATA).toPandas()
    assert len(frame) and not frame.isna().any().any()
    if "similarity" in frame:
        assert frame.similarity.between(-1 - 1e-9, 1 + 1e-9).all()


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 18
