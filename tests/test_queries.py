"""Queries against their SQL equivalents on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = [n for n in entry.oracle_sql() if any(n in m.queries() for m in (entry.core_queries, entry.reference_queries, entry.resolution_queries))]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(repr(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(repr, r)) for r in cur.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
