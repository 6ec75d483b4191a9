"""Every query with SQL against DuckDB at the smallest scale (where the driver's tables are at hand)."""

import os

import pytest

from vecforge.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(r):
    return sorted(tuple("" if v is None else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v) for v in x) for x in r)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    assert rows(tuple(r[c] for c in cols) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in rel.fetchall())
