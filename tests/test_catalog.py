"""Every query against its SQL over the smallest driver tables."""

from pathlib import Path

import pytest

from lingoframe import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, engine, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = engine.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
    kinds = dict(found.dtypes)
    assert [TYPES[kinds[c]] for c in columns] == [str(t) for t in wanted.types]
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(map(tuple, found.select(columns).collect()), key=key) == sorted(wanted.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
