"""Every query of the catalogue that has SQL, against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from folioflow.plans import catalog
from folioflow.plans.views import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
