"""Every query with an oracle SQL twin agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from haze.sources.tables import TABLES
from tools.oracle_check import close, rows_of

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, sf_small, name):
    got = E.queries()[name](spark, sf_small).toPandas()
    want = con.execute(SQL[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert all(close(a, b) for a, b in zip(gr, wr))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["city", "aqi_class", "n_readings"]
