"""Registered queries: the entry runs, and each query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.plans import catalog, decoding, derived, items, signals, stored  # noqa: F401  (these add to the registered queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = duck.execute(catalog.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(x) for x in r]) for r in rel.fetchall())
    assert sorted(str([plain(r[c]) for c in names]) for r in df.collect()) == want


