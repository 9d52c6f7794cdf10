"""Every query with a SQL twin gives the twin's rows on the smallest driver tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables are not here")
MODULES = [m for m in entry._modules() if m.__name__ != entry.LLM]
QUERIES = {k: v for m in MODULES for k, v in m.queries().items()}
TWINS = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_twins_belong_to_queries():
    assert not set(TWINS) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    twin = duck.execute(TWINS[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, twin.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
