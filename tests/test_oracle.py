"""Every query with SQL gives the rows that DuckDB gives; none is empty. LOAMWORKS_SF names another folder of tables."""

import os

import duckdb
import pytest
from loamworks.plans import dialect, registry

SF = os.environ.get("LOAMWORKS_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in dialect.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want
    assert got


def test_no_views_left(spark):
    registry.queries()["slug_titles"](spark, SF).count()
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]
