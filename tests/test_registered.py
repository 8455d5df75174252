"""Registered queries against their SQL on the smallest tables, and what the views refuse."""

import pathlib

import duckdb
import pytest

from rosterlake import registered, registered_jobs, registered_more
from rosterlake.operators import ledger, matching, roster as views

SF = "/root/testdata/sf0.001"
QUERIES = registered.QUERIES | registered_more.QUERIES | registered_jobs.QUERIES
ORACLES = registered.ORACLES | registered_more.ORACLES | registered_jobs.ORACLES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_marketing_outputs_carry_no_internal_column(spark):
    rows = registered.roster(spark, SF)
    with pytest.raises(ValueError):
        views.guard_marketing(rows)
    with pytest.raises(ValueError):
        views.marketing_rows(rows, status="Verified")
    with pytest.raises(ValueError):
        views.admin_view(rows, stream="no such stream")


def test_views_are_uncut_unless_asked(spark):
    rows = registered.roster(spark, SF)
    assert views.admin_view(rows).count() == rows.count()
    assert views.admin_view(rows, limit=7, offset=3).count() == 7


def test_a_call_without_endpoint_is_not_the_total(spark):
    calls = spark.createDataFrame([(1, None, 2.0, 9.0), (2, "a", 0.1, 8.0), (3, "a", 0.2, None)], "seq int, endpoint string, credits_charged double, balance double")
    got = {(r.endpoint, r.is_total): (r.calls, float(r.credits), r.balance) for r in ledger.spend_by_endpoint(calls).collect()}
    assert got == {(None, False): (1, 2.0, 9.0), ("a", False): (2, 0.3, 8.0), (None, True): (3, 2.3, 8.0)}


def test_every_number_of_a_key_is_listed(spark):
    numbers = [f"98{i:08d}" for i in range(1200, 1230)]
    contacts = spark.createDataFrame([(i, "Lakeview College", "Kerala", "BCA", n) for i, n in enumerate(numbers)], "pos int, name string, state string, stream string, phones string")
    orgs = spark.createDataFrame([("LAKEVIEW COLLEGE", "kerala", "BCA"), ("Other Place", "kerala", "BCA")], "name string, state string, stream string")
    got = {r.name: r for r in matching.staged_match(orgs, matching.phone_indexes(matching.phone_sightings(contacts))).collect()}
    assert got["LAKEVIEW COLLEGE"].all_phones_found == ", ".join(f"+91-{n}" for n in numbers)
    assert got["LAKEVIEW COLLEGE"].n_phones == 30 and got["Other Place"].all_phones_found == ""
