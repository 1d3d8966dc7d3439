"""Every query with SQL against DuckDB on the smallest tables; the others at least run."""

import math
from pathlib import Path

import duckdb
import pytest

from sievefold.plans import catalog

catalog.load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLE:
        found = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["term_id", "files", "occurrences", "in_name", "in_content"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
