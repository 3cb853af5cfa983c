import random

import pytest

from rosterlens.llm import mojibake as m

CLEAN = ["Jürgen Großmann", "Noémie Lefèvre", "São João", "JOÃO and CONCEIÇÃO", "£399 · renew", "30°C on set", "¿es la misma?", "Søren Kjær", "Łukasz Żak", "Anna Smith", "прошу проверить запись", "Мария Волкова", "café déjà vu", "naïve – “quoted” – text", "Müller’s page", "срок до конца года", "मारिया शर्मा", "Âncora do programa"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    words = sorted({w for t in CLEAN for w in t.split()})
    texts = CLEAN * 40 + [" ".join(rng.sample(words, 3)) for _ in range(2000)]
    return m.fit(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "t string"))


CHAINS = [("cp1252", "utf_8"), ("latin_1", "utf_8"), ("cp1250", "utf_8"), ("cp1251", "utf_8"), ("cp437", "utf_8"), ("cp850", "utf_8"), ("mac_roman", "utf_8")]


def test_clean_texts_stay(model):
    r = m.Restorer(*model)
    assert [t for t in CLEAN if r(t) is not None] == []


@pytest.mark.parametrize("chain", CHAINS)
def test_round_trip(model, chain):
    r = m.Restorer(*model)
    for t in CLEAN:
        g = m.garble(t, chain)
        if g and g != t:
            got = r(g)
            assert got is not None and got[0] == t, (t, g, got)


def test_single_byte_chains_and_repeated_garbling(model):
    r = m.Restorer(*model)
    for chain in (("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866")):
        assert r(m.garble("прошу проверить запись", chain))[0] == "прошу проверить запись"
    twice = m.garble(m.garble("Jürgen Großmann", ("cp1252", "utf_8")), ("cp1252", "utf_8"))
    assert r(twice)[0] == "Jürgen Großmann"


def test_in_places_and_lost_characters(model):
    r = m.Restorer(*model)
    assert r("São JoÃ£o")[0] == "São João"
    assert r("café déjà vu – " + m.garble("Größe", ("cp437", "utf_8")))[0] == "café déjà vu – Größe"
    assert r("Brud�ikouri")[1] == "lost"


def test_table(spark, model):
    rows = [(1, m.garble("Noémie", ("cp1252", "utf_8")), "c"), (1, m.garble("Noémie", ("cp1252", "utf_8")), "c"), (2, None, None), (3, "", ""), (4, "plain", ""), (5, "é" * 200_000, ""), (6, "Noémie Lefèvre", "")]
    df = spark.createDataFrame(rows, "id int, t string, restored string")
    assert [(r.id, r.restored) for r in m.restore(df, "t", ["id"], model).collect()] == [(1, "Noémie"), (1, "Noémie")]
    assert m.restore(df.limit(0), "t", ["id"], model).count() == 0
    with pytest.raises(ValueError):
        m.restore(df, "t", ["restored"], model)
    assert m.fit(df.limit(0).select("t"))[1] == m.LEAST_MARGIN


def test_the_margin_does_not_rise_with_the_share_of_garbled_records(spark):
    """A third of all records is one client's, read in the wrong code page; copies of one text count once."""
    rng = random.Random(5)
    names = [f"{a} {b}" for a in ("Jürgen", "Noémie", "São", "Søren", "Мария", "Иван", "Łukasz", "José") for b in ("Großmann", "Lefèvre", "João", "Kjær", "Волкова", "Петров", "Żak", "Núñez")]
    clean = names * 20
    bad = [g for t in names if (g := m.garble(t, ("koi8_r", "cp1251"))) and g != t] * 12
    hot = [m.garble("Мария Волкова", ("mac_roman", "cp1251"))] * 300
    rng.shuffle(clean)
    few, many = (m.fit(spark.createDataFrame([(t,) for t in x], "t string"))[1] for x in (clean, clean + bad + hot))
    assert many[1] <= 2 * few[1] and many[0] <= 2 * few[0]
    got = m.restore(spark.createDataFrame([(t,) for t in bad], "t string"), "t", [], m.fit(spark.createDataFrame([(t,) for t in clean + bad + hot], "t string")))
    assert got.filter("chains = 'koi8_r>cp1251'").count() > 0.9 * len(bad)


def test_the_cap_of_the_margin_is_that_of_all_records_and_chains(spark, monkeypatch):
    """2,000 names by brute force: each counts once for every chain that can garble it."""
    rng = random.Random(12)
    syl = ["во", "ло", "ми", "ре", "кан", "тор", "ше", "né", "ção", "ür", "jæ", "Ł"]
    names = sorted({" ".join("".join(rng.choices(syl, k=rng.randint(2, 4))).title() for _ in range(rng.randint(1, 3))) for _ in range(2000)})
    seen = []
    monkeypatch.setattr(m, "validated_margin", lambda gains, planted: seen.append((gains, planted([0, 1]))) or (4.0, 4.0))
    counts, _ = m.fit(spark.createDataFrame([(t,) for t in names + names[:50]], "t string"))
    (gains, planted), model = seen[0], m.Model(counts)
    texts = [t for t in names if not m.looks_undoable(t)]
    assert len(texts) > 1600 and gains[0].sum() == gains[1].sum() == len(texts)
    for kind in (0, 1):
        want = [0] * m.BINS
        for t in texts:
            for chain in m.KINDS[kind]:
                g = m.garble(t, chain)
                if g is not None and g != t:
                    words = [(x, y, s) for x, y in zip(t.split(" "), g.split(" "), strict=True) if x != y and (s := model.score(x) - model.score(y)) > 0]
                    told = words if kind == 0 or sum(c != d for x, y, _ in words for c, d in zip(x, y, strict=True)) >= m.LEAST_CHANGED else []
                    want[min(m.BINS - 1, int(4 * sum(s for *_, s in told)))] += 1
        # sums of floats may fall on either side of a bin's edge
        assert planted[kind].sum() == sum(want) and abs(planted[kind] - want).sum() <= 2 + sum(want) / 1000


def test_the_cap_is_asked_for_where_it_can_decide():
    def at(*bins):
        out = m.np.zeros(m.BINS)
        for b, n in bins:
            out[b] = n
        return out

    asked = []
    gains = m.np.stack([at((0, 100)), at((0, 90), (40, 10))])  # a tenth gain 10
    for cap, want in ((at((24, 100)), 6.0), (at((0, 2), (24, 98)), 4.0), (at((0, 1), (24, 99)), 6.0), (at((400, 100)), 20.0), (at(), 20.0)):
        got = m.validated_margin(gains, lambda kinds, cap=cap: asked.append(kinds) or m.np.stack([at(), cap]))
        assert got == (m.LEAST_MARGIN[0], want)
    assert asked == [[1]] * 5


#: Queries whose model of clean text must rest on all rows.
WHOLE = ["p3_linked", "p4_restored", "p5_found"]


@pytest.mark.parametrize("query", WHOLE)
def test_no_model_is_fitted_on_part_of_the_rows(spark, query, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from rosterlens.llm import queries

    def refused(*_):
        raise AssertionError("part of a table is read")

    fitted, fit = [], m.fit

    def whole(texts):
        with monkeypatch.context() as at:
            for part in ("limit", "sample", "take"):
                at.setattr(DataFrame, part, refused)
            fitted.append(fit(texts))
        return fitted[-1]

    monkeypatch.setattr(m, "fit", whole)
    assert queries.queries()[query](spark, "/root/testdata/sf0.001").count() >= 0 and len(fitted) == 1
