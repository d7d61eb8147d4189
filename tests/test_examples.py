"""Every example next to its SQL, on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import examples
from tools.compare import TABLES, rows_of

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(examples.all_queries()) == set(examples.all_oracles())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_example(spark, con, name):
    df = contract.queries()[name](spark, str(SF))
    got = rows_of(df.columns, df.collect())
    if name not in contract.oracle_sql():
        assert got
        return
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
