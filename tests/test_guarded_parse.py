import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.operators import guarded_parse as g

FILES = "file_id int, delimiter string, header array<string>, header_map map<string,string>"


def run(spark, raws, header=("row_id", "name", "year"), to=None, delimiter=",", block=None):
    to = {"row_id": "row_id", "name": "name", "year": "active_year"} if to is None else to
    lines = spark.createDataFrame([(i, 1, r) for i, r in enumerate(raws)], "line_id int, file_id int, raw_line string")
    files = spark.createDataFrame([(1, delimiter, list(header), to)], FILES)
    return {r.line_id: r for r in g.guarded_parse(lines, files).collect()}


CASES = [
    ("1,A B,1999", None), ('1,"A,B",1999', None), ('1,"A ""x"" B",', None), ('1,A "x" B,1999.0', None), ("1,A\nB,", None), ('1,"A\nB",', None),
    ('1,"A,1999', "quoting"), ('1,"A"x,1999', "quoting"), ('"1,A,1999', "quoting"), ('1,"A" ,1999', "quoting"),
    ("1,A", "columns"), ("1,A,1999,", "columns"), ("", "columns"), (None, "columns"), ("1,A,1999,x,y", "columns"),
    ("x,A,1999", "value"), (",A,1999", "value"), ("1, ,1999", "value"), ("1,A,99", "value"), ("1,A,1799", "value"), ("1,A,2101", "value"), ("1,A,1999.5", "value"), ("1,A,２００５", "value"),
    (" 7 , A , 2001 ", None), ("1,A,1800", None), ("1,A,2100.0", None), ('""""', "columns"), ('1,"",1999', "value"),
]


def test_reasons_in_their_order(spark):
    got = run(spark, [r for r, _ in CASES])
    assert [(r, got[i].reason) for i, (r, _) in enumerate(CASES)] == CASES
    assert got[1].name == "A,B" and got[2].name == 'A "x" B' and got[3].name == 'A "x" B' and got[4].name == "A\nB"
    assert got[23].row_id == "7" and got[23].name == "A" and got[23].active_year == "2001"


def test_a_bad_record_does_not_disturb_its_neighbours(spark):
    raws = [f"{i},N{i},2000" if i % 7 else f'{i},"N{i},2000' for i in range(2000)]
    got = run(spark, raws)
    assert all((got[i].reason is None and got[i].name == f"N{i}") if i % 7 else got[i].reason == "quoting" for i in range(2000))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text('ab",;\n\r 1', max_size=12), min_size=1, max_size=40), st.sampled_from(",;|\t"))
def test_blocks_agree_with_the_strict_scan(raws, delimiter):
    import pyarrow as pa

    seen = []
    for part, columns in g._blocks(pa.array(raws, pa.string()), delimiter, 2):
        seen += part.tolist()
        assert columns is not None or len(part) == 1
        for k, i in enumerate(part):
            strict = g.split_record(raws[i], delimiter)
            if columns is not None:
                assert strict == [c[k].as_py() for c in columns]
            else:  # nothing is scanned strictly without need
                assert "\r" in raws[i] or "\n" in raws[i] or strict is None or len(strict) != 2
    assert sorted(seen) == list(range(len(raws)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text('ab", \n', max_size=5), min_size=1, max_size=5))
def test_strict_scan_reads_what_csv_writes(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    assert g.split_record(out.getvalue(), ",") == fields


def test_unknown_files_nulls_duplicates_and_other_delimiters(spark):
    lines = spark.createDataFrame([(1, 1, "1;A"), (1, 1, "1;A"), (2, 9, "1;A"), (3, None, "1;A"), (4, 2, "1§A"), (5, 3, "1,A"), (6, 4, "x")], "line_id int, file_id int, raw_line string")
    lines = lines.selectExpr("*", "'q' AS reason", "'q' AS name", "'q' AS header")
    m = {"id": "row_id", "n": "name", "n2": "name"}
    files = spark.createDataFrame([(1, ";", ["id", "n"], m), (1, ";", ["id", "n"], m), (2, "§", ["id", "n"], m), (3, None, ["id", "n"], None), (4, ",", None, m)], FILES)
    got = sorted((r.line_id, r.reason, r.row_id, r.name) for r in g.guarded_parse(lines, files).collect())
    assert got == [(1, None, "1", "A"), (1, None, "1", "A"), (2, "file", None, None), (3, "file", None, None), (4, None, "1", "A"), (5, None, None, None), (6, "file", None, None)]
    assert g.guarded_parse(lines.limit(0), files).count() == 0
    assert g.guarded_parse(lines, files.limit(0)).filter("reason = 'file'").count() == 7


def test_two_headings_for_one_field_and_a_long_record(spark):
    got = run(spark, ["1,A,B", "2," + "x" * 3_000_000 + ",C"], ("row_id", "n", "n2"), {"row_id": "row_id", "n": "name", "n2": "name"})
    assert got[0].name == "A" and len(got[1].name) == 3_000_000
