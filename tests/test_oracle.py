"""Every registered query with a DuckDB twin agrees with it on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

SQL = E.oracle_sql()
NAMES = sorted(SQL)
FAST = os.environ.get("QUARRY_FAST_ORACLE") is not None


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_entry():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("name", NAMES[::4] if FAST else NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
