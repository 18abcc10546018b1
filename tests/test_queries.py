"""Queries with SQL are held against DuckDB on the smallest tables; entry() must give rows."""

from __future__ import annotations

import os

import pytest

from lumora import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = plans.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.execute(plans.oracle_sql()[name])
    at = [x[0] for x in rel.description]
    assert sorted(at) == cols
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key) == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, name):
    """All columns are evaluated, twice in a session: a count alone would prune them."""
    first, again = (sorted(map(str, plans.queries()[name](spark, DIR).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
