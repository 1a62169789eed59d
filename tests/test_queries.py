"""Every map query with SQL gives the rows that an independent engine gives."""

import math

import duckdb
import pytest

from plumbline.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


def in_order(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is not None, "" if v is None else str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, engine, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    other = engine.sql(catalog.SQL[name])
    assert sorted(other.columns) == columns
    rows = in_order(df.select(*columns).collect())
    assert rows and rows == in_order(other.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
