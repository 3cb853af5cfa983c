import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.llm import lookalikes as lk

CASES = [
    ("Matteo Rossi", "Matteo Rossi", ["space"]), ("Ｆａｒｉｄ Ｄ．", "Farid D.", ["form"]), ("José", "José", ["accent"]), ("a​b­", "ab", ["invisible"]), ("Еlizabeth Κim", "Elizabeth Kim", ["letter"]),
    ("Роналд Рей", "Роналд Рей", []), ("Рaимонд", "Раимонд", ["letter"]), ("Αλέξης", "Αλέξης", []), ("अन्‍नल", "अन्‍नल", []), ("अन﻿", "अन", ["invisible"]), ("José Ärö", "José Ärö", []), ("Jean‐Luc", "Jean-Luc", ["form"]),
    ("Liﬆen", "Listen", ["form"]), ("  a  b ", "a b", []), ("", "", []), (None, None, []), ("́", "́", ["accent"]), ("q̂́", "q̂́", ["accent"]), ("ệ".replace("ệ", "ệ"), "ệ", ["accent"]), ("𝐉𝐨", "Jo", ["form"]),
]


def test_forms_and_kinds(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, *_) in enumerate(CASES)] + [(0, CASES[0][0], "x")], "id int, t string, kinds string")
    rows = lk.unify(df, "t", ["id"]).sort("id").collect()
    assert len(rows) == len(CASES) + 1
    assert [(r.text, r.unified, r.kinds) for r in rows[1:]] == CASES


def test_empty_table_long_text_and_clash(spark):
    df = spark.createDataFrame([("é" * 500_000,)], "t string")
    assert lk.unify(df, "t", []).first().unified == "é" * 500_000
    assert lk.unify(df.limit(0), "t", []).count() == 0
    with pytest.raises(ValueError):
        lk.unify(df.withColumnRenamed("t", "text"), "text", ["text"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=8), min_size=1, max_size=20))
def test_one_form_is_stable(texts):
    once, _ = lk.unify_array(pa.array(texts))
    again, _ = lk.unify_array(once)
    assert again.to_pylist() == lk.unify_array(again)[0].to_pylist()
    assert len(once) == len(texts)


@settings(max_examples=150, deadline=None)
@given(st.text("aeiouncsAEzý ", max_size=8), st.lists(st.sampled_from("̧́̈̂̃̌"), max_size=3))
def test_composition_is_that_of_unicode(s, marks):
    t = s.strip() + "e" + "".join(marks[:1])
    assert lk.unify_array(pa.array([t]))[0].to_pylist()[0] == " ".join(unicodedata.normalize("NFC", t).split())


def test_slices_of_arrays():
    a = pa.array(["ａ", "b c", "d"]).slice(1)
    assert lk.unify_array(a)[0].to_pylist() == ["b c", "d"]
