"""Every query against its DuckDB twin on the small tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import catalog

TABLES = os.environ.get("PALIMPSEST_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, TABLES)
    want = duck.execute(catalog.oracle_sql()[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), [d[0] for d in want.description])


def test_names():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
