"""Every oracle-checked query agrees with its DuckDB statement at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import TABLES, digest
from tests.conftest import SF001


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    want = cur.fetchall()
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert digest(got, df.columns)[0] == digest(want, cols)[0]


def test_every_query_has_an_entry(spark):
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0
