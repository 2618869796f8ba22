"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pytest

from gridloom import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    r = duck.execute(engine.oracle_sql()[name])
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(repr(tuple(x[i] for i in order)) for x in r.fetchall())
    assert cols == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_runs(spark, name):
    assert engine.queries()[name](spark, SF).count() > 0
