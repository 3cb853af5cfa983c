"""Chances of agreement among all pairs, counted without making the pairs, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rosterlens.llm import linkage


def test_chances_are_those_of_all_pairs(spark):
    own = random.Random(6)
    some = lambda x: own.choice([None, [], *[[v] for v in x], x[:2]])
    a = [(i, "g", f"s{i}", "", own.choice([None, "o1", "o2"]), own.choice([None, "b1", "b2"]), own.choice([None, "c1", "c2", "c9"]), own.choice([None, 1900, 1950, 2000, 2020])) for i in range(60)]
    b = [(i, "g", f"s{i}", "", some(["o1", "o2", "o3"]), some(["b1", "b2"]), own.choice([None, 1880, 1930, 1990]), own.choice([None, 1940, 2010]), some(["c1", "c2"])) for i in range(50)]
    req = spark.createDataFrame(a, "__a int, given string, surname string, middle string, occupation string, bucket string, country string, year int")
    cand = spark.createDataFrame(b, "__b int, given string, surname string, middle string, occupations array<string>, roles array<string>, birth_year int, death_year int, citizenship array<string>")
    pa, pb = req.select("__a", F.struct(*linkage.ASKED).alias("pa")), cand.select("__b", F.struct(*linkage.KNOWN).alias("pb"))
    got = linkage.chance_levels(pa, pb)
    facts = linkage.compare_facts(*[F.col(f"pa.{c}") for c in ("occupation", "bucket", "country", "year")], {f: F.col(f"pb.{f}") for f in linkage.FACTS})
    rows = pa.crossJoin(pb).select(*[c.cast("int").alias(k) for k, c in facts.items()]).collect()
    assert {k: v.tolist() for k, v in got.items()} == {k: [float(Counter(r[k] for r in rows)[i]) for i in range(linkage.LEVELS[k])] for k in facts}
    assert linkage.chance_levels(pa.limit(0), pb) == {} and linkage.chance_levels(pa, pb.limit(0)) == {}


def test_common_surnames_are_no_given_names(spark):
    own = random.Random(7)
    given, family = ["Anna", "Robert", "Maria", "Igor"], ["Smith", "Garcia"] + [f"Rare{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    names = [f"{own.choice(given)} {own.choice(family[:2]) if own.random() < 0.4 else own.choice(family)}" for _ in range(3000)] + ["Smith, Anna"] * 20 + ["Garcia"] * 10
    got = linkage.common_words(spark.createDataFrame([(n,) for n in names], "name string"))
    assert set(got) == {"ana", "robert", "maria", "igor"}
