"""Every query with an SQL equivalent gives the same rows."""

import datetime
import decimal

import duckdb
import pytest

from tidelog.plans import control  # noqa: F401
from tidelog.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "conversations", "customer", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    ours = QUERIES[name](spark, SF)
    theirs = db.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert {c: KINDS[t] for c, t in ours.dtypes} == dict(zip(theirs.columns, map(str, theirs.types)))
    got = sorted(([plain(r[c]) for c in columns] for r in ours.collect()), key=repr)
    at = [theirs.columns.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in theirs.fetchall()), key=repr)
    assert got == want and got
