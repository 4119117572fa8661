"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks.compare import rows_of
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(QUERIES) == set(ORACLES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    ran = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(ran.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ran.columns, ran.fetchall())
