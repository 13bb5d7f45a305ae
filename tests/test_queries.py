"""Every query with SQL against DuckDB over the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, db, name):
    got = contract.queries()[name](spark, SF)
    told = db.execute(contract.oracle_sql()[name])
    names = [c[0] for c in told.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    at = [names.index(c) for c in sorted(names)]
    b = sorted(tuple(plain(r[i]) for i in at) for r in told.fetchall())
    assert a == b


@pytest.mark.parametrize("name", [n for n in sorted(contract.queries()) if n not in contract.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_runs(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
