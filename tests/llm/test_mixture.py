import os

import pandas as pd
import pytest

from rosterlens.llm import mixture

TARGET = "source string, target_share double, max_repeats int"
ROWS = "id long, source string, lang string, topic string, tokens long"


def test_raking_meets_sources_and_caps():
    cells = pd.DataFrame([(s, lang, t, n) for s, k in (("a", 8000), ("b", 900), ("c", 300)) for lang, t, n in (("en", "x", k), ("de", "x", k // 2), (None, "y", k // 4))], columns=["source", "lang", "topic", "tokens"])
    repeats, total = mixture.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.1, "gone": 0.1}, {"a": 2, "b": 3, "c": 4, "gone": 1})
    got = (cells["tokens"] * repeats).groupby(cells["source"]).sum() / total
    assert got["a"] == pytest.approx(0.5 / 0.9, rel=1e-6) and got["b"] == pytest.approx(0.3 / 0.9, rel=1e-6)
    assert all(repeats <= cells["source"].map({"a": 2, "b": 3, "c": 4}) + 1e-9)


def test_sample(spark):
    rows = [(i, ["a", "b", "c", None, "z"][0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i % 100 == 8 else 3 if i % 10 == 8 else 4], ["en", "de", None][i % 3], ["x", None][i % 2], 50 + i % 100) for i in range(20_000)]
    rows += [(30_000, "a", "en", "x", 0), *rows[:500]]
    sized = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS repeats", "2 AS z")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("none", 0.1, 3)], TARGET)
    sample, shares = mixture.mix(sized, "id", targets)
    got = {r.source: r for r in shares.collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert got[s].actual_share == pytest.approx(want / 0.9, abs=0.004)
    assert got["none"].tokens == 0 and got["none"].actual_share == 0
    caps = {"a": 1, "b": 2, "c": 5}
    taken = sample.collect()
    assert len({r.id for r in taken}) == len(taken) and all(1 <= r.repeats <= caps[r.source] for r in taken)
    again = {(r.id, r.repeats) for r in mixture.mix(sized.repartition(7), "id", targets)[0].collect()}
    assert again == {(r.id, r.repeats) for r in taken}


def test_empty_tables(spark):
    sized = spark.createDataFrame([], ROWS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    sample, shares = mixture.mix(sized, "id", targets)
    assert sample.count() == 0 and [(r.source, r.tokens, r.actual_share) for r in shares.collect()] == [("a", 0, None)]
    assert mixture.mix(spark.createDataFrame([(1, "a", None, None, 5)], ROWS), "id", targets.limit(0))[0].count() == 0


@pytest.mark.skipif(not os.path.exists(mixture.TOKENIZER), reason="no tokenizer")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x" * 200_000)], "id long, t string")
    got = {r.id: r.tokens for r in mixture.count_tokens(df, "t", ["id"]).collect()}
    assert got[1] == len(mixture._encoding(mixture.TOKENIZER).encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100
