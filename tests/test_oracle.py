"""Every registered query against its DuckDB SQL twin at sf0.001 (the driver does the same at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from labelops.plans import catalog
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_reason():
    no_sql = set(catalog.QUERIES) - set(SQL)
    assert not no_sql


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "n", "pct"] and df.count() >= 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]
