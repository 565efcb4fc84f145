"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import _rows

DATA = Path("/root/testdata/sf0.001")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    df = contract.queries()[name](spark, str(DATA))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = engine.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, result.fetchall())
