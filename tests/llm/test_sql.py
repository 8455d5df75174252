"""Registered queries of this subpackage against their SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

from rosterlake.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_rows_equal_the_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, SF)
    want = sql.sql(oracles.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
