from collections import Counter
from pathlib import Path

import duckdb
import pytest

from rosterlens.llm import queries as q

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = q.queries()[name](spark, str(DATA))
    cur = c.execute(q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(tuple(r[x] for x in columns) for r in df.collect()) == Counter(cur.fetchall())
