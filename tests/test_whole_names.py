"""Queries on whole names against brute force on a small fixture: every spelling, marks stripped, all tiers of agreement."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rosterlens.functions import names

INTAKE = [
    (1, "José Núñez", "music"), (2, "Jose Nunez", "film"), (3, "BJÖRK", None), (4, "Zoë K. Ödegård", "music"), (5, "No Body", None), (6, None, None), (7, "Renée", "film"),
    (8, "A. R. Rahman", "music"), (9, "...", None), (10, "Nunez, Jose", None), (11, "AR Rahman", None), (12, "Maria Anna Long Keller", "film"), (13, "Rahman Allah Rakha", None), (14, "Пётр Иванов", None),
]
CANDIDATE = [
    ("a", "Jose Nunez", ["music"]), ("b", "José Núñez", ["film"]), ("c", "Bjork", ["music"]), ("d", "Zoe Kaye Odegard", None), ("e", "Renee", ["music"]), ("f", "Allah Rakha Rahman", ["music"]),
    ("g", None, None), ("h", "J. Nuñez", ["film"]), ("i", "Maria Keller", ["film"]), ("j", "Maria Zsuzsanna Gwendolyn Xenia Philippa Keller", None), ("k", "Петр Иванов", ["film"]),
]


def normal(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w\s]+", " ", re.sub(r"([a-z])\.", r"\1 ", s)).split())


def initials(n):
    w = n.split()
    return " ".join([x[0] for x in w[:-1]] + w[-1:])


def spellings(s):
    """The variants of a name: itself, without marks, normal, initials, first and last, initials drawn together, flipped."""
    n = normal(s)
    w = n.split()
    out = [s.strip(), "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip(), n]
    if len(w) > 1:
        out += [initials(n), f"{w[0]} {w[-1]}"]
        lead = "".join(x for x in w[:-1] if len(x) == 1)
        out += [f"{lead} {w[-1]}"] if len(lead) > 1 else []
        front, comma, back = (x.strip() for x in s.partition(","))
        out += [f"{back} {front}"] if comma and front and back else []
    seen = set()
    return [x for x in out if x and not (x.lower() in seen or seen.add(x.lower()))][:10]


def agreement(query, label):
    if not query or not label:
        return 0.0, "none"
    if query.strip() == label.strip():
        return 1.0, "exact"
    a, b = normal(query), normal(label)
    if a and a == b:
        return 0.97, "normalized"
    if a and initials(a) == initials(b):
        return 0.9, "initials"
    s, t = set(a.split()), set(b.split())
    if s and s == t:
        return 0.88, "token"
    overlap = len(s & t) / len(s | t) if s and t else 0.0
    return round(0.6 * difflib.SequenceMatcher(None, a, b).ratio() + 0.4 * overlap + 1e-12, 3), "fuzzy"


def brute(floor=0.62):
    out = {}
    for i, name, role in INTAKE:
        for e, label, roles in CANDIDATE:
            if name is None or label is None or not {normal(v) for v in spellings(name)} & {normal(v) for v in spellings(label)} - {""}:
                continue
            score, how = agreement(name, label)
            base = 0 if role is None or not roles else 0.6 if role in roles else -0.25
            if score >= floor:
                out[i, e] = (score, how, round(base + (score - 1) * 0.5 + 1e-9, 3))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("names")
    i = spark.createDataFrame([(*r, None, None) for r in INTAKE], "intake_id long, name string, expected_role string, country string, active_year int")
    c = spark.createDataFrame([(*r, [], None, None, {}) for r in CANDIDATE], "entity_id string, label string, roles array<string>, citizenship array<string>, birth_year int, death_year int, external_ids map<string,string>")
    i.write.parquet(str(at / "intake.parquet"))
    c.write.parquet(str(at / "candidate.parquet"))
    return str(at)


def test_names_meet_and_are_ranked(spark, folder):
    run = lambda name: entry.queries()[name](spark, folder).collect()
    want = brute()
    assert {(1, "a"), (2, "b"), (3, "c"), (4, "d"), (7, "e"), (10, "a"), (12, "i")} <= set(want) and {"initials", "normalized", "exact", "token", "fuzzy"} == {h for _, h, _ in want.values()}
    assert {(r.intake_id, r.entity_id): (r.label_score, r.how, r.role_score) for r in run("role_scores")} == want
    order = {k: sorted((e for j, e in want if j == k), key=lambda e: (-want[k, e][2], e)) for k, _ in want}
    assert {(r.intake_id, r.entity_id, r.card) for r in run("disambiguation_cards")} == {(k, e, n + 1) for k, o in order.items() for n, e in enumerate(o[:6])}
    assert {(r.intake_id, r.n, r.top) for r in run("rank_margin")} == {(k, len(o), o[0]) for k, o in order.items()}
    assert {r.intake_id for r in run("unmatched_intakes")} == {k for k, name, _ in INTAKE if name is not None and k not in order}


def test_matches_rejects_and_variants(spark, folder):
    run = lambda name: entry.queries()[name](spark, folder).collect()
    assert {(r.intake_id, r.entity_id): (r.label_score, r.how) for r in run("match_label")} == {k: v[:2] for k, v in brute(-1).items()}
    label, name = {e: x for e, x, _ in CANDIDATE}, {i: x for i, x, _ in INTAKE}
    loose = {(i, e) for i, n, _ in INTAKE for e, x, _ in CANDIDATE if n and x and normal(n) and normal(x) and normal(n).split()[-1] == normal(x).split()[-1]}
    assert {(r.intake_id, r.entity_id): (r.score, r.closest) for r in run("rejected_labels")} == {(i, e): (s, label[e]) for i, e in loose if (s := agreement(name[i], label[e])[0]) < 0.62}
    got = {}
    for r in run("name_variants"):
        got.setdefault(r.intake_id, {})[r.place] = r.variant
    assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == {i: spellings(n) for i, n, _ in INTAKE if n is not None}


def test_names_in_two_scripts_count_for_less(spark):
    df = spark.createDataFrame([("Petr Ivanov", "Петр Иванов", "petr ivanov", "петр иванов", 0.1, 0.9), ("Petr Ivanov", "Pjotr Iwanow", "petr ivanov", "pjotr iwanow", 0.7, 0.9)], "q string, l string, nq string, nl string, ratio double, other double")
    t = names.fuzzy_tier(F.col("q"), F.col("l"), F.col("nq"), F.col("nl"), F.col("ratio"), F.col("other"))
    assert [tuple(r.t) for r in df.select(t.alias("t")).collect()] == [(0.75, "translit"), (0.42, "fuzzy")]
    v = names.variants(F.lit("Петр Иванов"), F.lit("Петр Иванов"), F.lit("петр иванов"), F.lit("Petr Ivanov"))
    assert df.select(v).first()[0][-1] == "petr ivanov"
