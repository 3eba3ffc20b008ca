"""Every registered query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(v):
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def key(row):
    return tuple((x is None, str(x) if not isinstance(x, float) else "%020.3f" % x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=key)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=key)
    assert len(rows) == len(expected) > 0
    for a, b in zip(rows, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-12, abs=1e-9, nan_ok=True) if isinstance(y, float) else y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
