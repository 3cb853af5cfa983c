from pathlib import Path

import pytest

from rosterlens.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {"p1_found": ["intake_id", "entity_id"], "p2_found": ["parsed_id", "field", "ref_id"], "p3_found": ["sheet_id", "entity_id"], "p4_found": ["table_name", "record_id"], "p5_found": ["table_name", "record_key"], "p8_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "first_word", "last_word"]}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = q.queries()[name](spark, str(DATA))
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


def test_a_driver_without_sql():
    assert set(q.oracle_sql()) <= set(q.queries())
