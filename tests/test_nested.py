import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlens.operators.nested import NoJson, child_table, json_elements, json_rejects, scan


def expected(text):
    try:
        root = json.loads(text)
    except (TypeError, ValueError):
        return []
    out = []

    def walk(x, path, parent):
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, [*path, k], parent)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                p = [*path, str(i)]
                if isinstance(v, dict):
                    out.append(("/".join(p), parent))
                    walk(v, p, "/".join(p))
                else:
                    walk(v, p, parent)

    walk(root, [], None)
    return out


def found(spark, texts, unrolled=16):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, j string")
    return sorted((r.k, r.child_path, r.parent_path) for r in json_elements(df, "j", ["k"], unrolled).collect())


def want(texts):
    return sorted((i, p, o) for i, t in enumerate(texts) for p, o in expected(t))


TEXTS = [
    '{"a":[{"b":1},{"c":[{"d":2},5,[{"e":3}]]}],"k":{"z":[1,[{"q":1}]]}}', "[]", "[{}]", "{}", '[{"a":{"b":[{"c":1}]}}]', '{"a":[{"x":"}]"}]}',
    '{"a":[{"x":1}', '{"a":[{"x":1}]} extra', '{"a":[{"x":1}]}}', '[{"a":1}][{"b":1}]', '[{"a":1}],[{"b":1}]', "", "   ", None, "text", '"[{}]"', '[{"\\u00e9/\\"":[{"y":1}]}]',
]


@pytest.mark.parametrize("unrolled", [16, 2])
def test_elements_at_any_depth_and_incomplete_texts(spark, unrolled):
    assert found(spark, TEXTS, unrolled) == want(TEXTS)


def test_very_deep_and_very_long_records(spark):
    deep = '{"a":[' * 40 + '{"z":1}' + "]}" * 40
    long = json.dumps({"a": [{"i": i, "t": "x" * 50} for i in range(5000)]})
    assert found(spark, [deep, long]) == want([deep, long])


tree = st.recursive(st.one_of(st.none(), st.integers(-5, 5), st.text("ab[]{}\"\\/", max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("kxy", min_size=1, max_size=2), x, max_size=3)), max_leaves=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(tree, min_size=30, max_size=30))
def test_any_json(spark, trees):
    texts = [json.dumps(t) for t in trees]
    assert found(spark, texts, 3) == want(texts)


def test_repeated_rows_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, '[{"a":1}]', "x", "y")] * 2, "k int, j string, value string, ordinal string")
    assert json_elements(df, "j", ["k"]).count() == 2
    assert json_elements(df.limit(0), "j", ["k"]).count() == 0
    with pytest.raises(ValueError):
        json_elements(df, "j", ["value"])


def test_child_table_keeps_links_and_optional_fields(spark):
    df = spark.createDataFrame([("k", '{"relations":[{"type":"a","url":{"r":"u"}},{"url":{}}],"other":[{"type":"z"}]}')], "k string, j string")
    rows = child_table(json_elements(df, "j", ["k"]), "relations", {"type": "$.type", "r": "$.url.r"}).sort("ordinal").collect()
    assert [(r.k, r.ordinal, r.type, r.r) for r in rows] == [("k", 0, "a", "u"), ("k", 1, None, None)]


def test_values_are_the_objects(spark):
    df = spark.createDataFrame([("k", '[{"a":[1,null,"x"]}]')], "k string, j string")
    assert json.loads(json_elements(df, "j", ["k"]).select(F.col("value")).first().value) == {"a": [1, None, "x"]}


@settings(max_examples=300, deadline=None)
@given(tree, st.integers(0, 60), st.sampled_from(["", "x", "]", ",", '"']))
def test_the_scanner_agrees_with_the_parser(t, cut, tail):
    text = json.dumps(t)
    for x in (text, text[: len(text) - cut % (len(text) + 1)], text + tail, " " + text + " \n"):
        try:
            json.loads(x)
            assert [("/".join(map(str, s)), None if o is None else "/".join(map(str, o))) for s, o, _, _ in scan(x)] == expected(x)
            assert all(isinstance(json.loads(x[a:b]), dict) for _, _, a, b in scan(x))
        except json.JSONDecodeError:
            with pytest.raises(NoJson):
                scan(x)


ODD = ['{"a":[{"x":1}],"a":[{"y":2},{"z":3}]}', '[{"b":1,"b":2}]', '[{"x":NaN}]', '[{"z":1,"a":1.50,"m":1e5,"é":"\\u00e9"}]', '[{"x":01}]']


def test_depth_does_not_change_what_a_record_gives(spark):
    """A key named twice, NaN, and how numbers and keys are rendered."""
    def rows(unrolled):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k int, j string")
        return sorted(map(tuple, json_elements(df, "j", ["k"], unrolled).collect()), key=str)

    assert rows(16) == rows(1)
    assert [(r[0], r[1]) for r in rows(16)] == [(0, "a/0"), (0, "a/1"), (1, "0"), (3, "0")]


@pytest.mark.parametrize("levels", [3_000, 100_000])
def test_records_of_any_depth(spark, levels):
    df = spark.createDataFrame([(1, "[" * levels + '{"a":1}' + "]" * levels)], "k int, j string")
    assert [r.child_path for r in json_elements(df, "j", ["k"]).collect()] == ["/".join(["0"] * levels)]
    if levels < 5_000:
        text = '{"a":[' * levels + '{"z":1}' + "]}" * levels
        got = json_elements(spark.createDataFrame([(1, text)], "k int, j string"), "j", ["k"], values=False)
        assert got.count() == levels and got.filter("parent_path IS NULL").count() == 1


def test_long_strings_and_what_is_no_json(spark):
    texts = ['[{"t":"' + "x" * 2_000_000 + '"}]', '[{"t":"' + '\\"' * 200_000 + '"}]', "", " \n", '{"a":[{"x":1}', '{"a":1} extra', '{"a" 1}', '{"a":tru', '{"a":"x', "[1,]", None, "[NaN]", "5", '"s"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, j string")
    assert {r.k for r in json_elements(df, "j", ["k"]).collect()} == {0, 1}
    assert {r.k: r.reason for r in json_rejects(df, "j", ["k"]).collect()} == {2: "empty", 3: "empty", 4: "cut off", 5: "trailing", 6: "syntax", 7: "cut off", 8: "cut off", 9: "syntax", 11: "syntax"}
