"""Every registered query with SQL against DuckDB."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(BASE).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, BASE)
    out = duck.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.columns, got.collect()), rows(names, out.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b, rel=1e-9, nan_ok=True) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered_with_a_function():
    assert all(callable(f) for f in entry.queries().values()) and set(ORACLES) <= set(entry.queries())
