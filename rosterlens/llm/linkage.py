"""Probabilistic record linkage: multi-pass blocking, agreement levels, expectation-maximisation, posteriors.

Pairs are compared as profiles: rows alike in everything compared are one profile, so that copies, however many, cost one
comparison. The EM runs over counts of agreement patterns, of which there are a bounded number whatever the number of pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise
from . import lookalikes, mojibake, person_names

#: Share of names in which a word must occur to count as common; there can be no more than some thousand such words.
COMMON_SHARE = 0.003
#: Rounds in which pairs are compared, by request, so that the profiles of one round alone are shuffled at a time.
ROUNDS = 2
#: Posterior from which a pair is a match.
THRESHOLD = 0.5

# -- names -------------------------------------------------------------------------------------------------------------


def _cleaned(texts: pa.Array, restorer: mojibake.Restorer | None) -> list[str]:
    if restorer is not None:
        texts = pa.array([t if not t or t.isascii() else (got[0] if (got := restorer(t)) else t) for t in texts.to_pylist()], pa.string())
    return lookalikes.unify_array(texts.cast(pa.string()).fill_null(""))[0].to_pylist()


def common_words(*names: DataFrame) -> dict[str, int]:
    """Given names: words in at least COMMON_SHARE of all names, with their number of names, that lead a name more often than they end one.

    Each df has one string column; names of one word, and initials, tell nothing of the order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        first: Counter = Counter()
        for batch in batches:
            for name in _cleaned(batch.column(0), None):
                words = [w for w in person_names.tokens(name)[0] if len(w) > 1]
                found.update(set(words))
                found[""] += bool(words)
                if len(words) > 1:
                    first[words[0]] += 1
                    first[words[-1]] -= 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([first[w] for w in found], pa.int64())], names=["word", "n", "lead"])

    every = reduce(DataFrame.unionAll, [x.toDF("name") for x in names])
    words = materialise(every.mapInArrow(count, "word string, n bigint, lead bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead")), "words")
    total = words.filter("word = ''").first()
    least = max(3, total.n * COMMON_SHARE) if total else 3
    out = {r.word: r.n for r in words.filter((F.col("word") != "") & (F.col("n") >= least) & (F.col("lead") >= 0)).collect()}
    discard(words)
    return out


@lru_cache(2)
def _parser(common: tuple[tuple[str, int], ...]) -> person_names.Parser:
    """Kept by each worker, with what it has looked up."""
    return person_names.Parser(dict(common))


def parse_names(df: DataFrame, key: str, text: str, common: dict[str, int], model=None) -> DataFrame:
    """key, ``name`` (as it is), ``given``, ``surname``, ``middle``; rows without a surname are left out."""
    src = df.select(F.col(key), F.col(text).alias("name")).filter(F.col("name").isNotNull())
    shared = model.shared if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(tuple(common.items()))
        restorer = mojibake.restorer(shared, model[1]) if shared else None
        for batch in batches:
            parsed = [parser(n) for n in _cleaned(batch.column(1), restorer)]
            keep = [i for i, p in enumerate(parsed) if p]
            at = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*at.columns, *[pa.array([parsed[i][j] for i in keep], pa.string()) for j in range(3)]], names=[key, "name", "given", "surname", "middle"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, *[T.StructField(c, T.StringType()) for c in ("given", "surname", "middle")]]))


# -- comparison --------------------------------------------------------------------------------------------------------

#: Levels of each comparison, best first; the named one says nothing for or against.
LEVELS = {"surname": 4, "given": 4, "middle": 4, "role": 4, "country": 3, "year": 4}
UNKNOWN = {"middle": 1, "role": 2, "country": 1, "year": 2}
#: Where EM starts: chances of the levels among matches.
START = {
    "surname": [0.75, 0.15, 0.095, 0.005], "given": [0.7, 0.2, 0.095, 0.005], "middle": [0.3, 0.4, 0.28, 0.02],
    "role": [0.5, 0.2, 0.25, 0.05], "country": [0.6, 0.35, 0.05], "year": [0.7, 0.15, 0.14, 0.01],
}


def surnames_agree(a: str, b: str) -> int:
    """0 the same, 1 one edit apart, 2 two edits apart or alike in their consonants, 3 none of these."""
    if a == b:
        return 0
    if a[0] == "~" or b[0] == "~":
        a, b = (x[1:] if x[0] == "~" else person_names.skeleton(x) for x in (a, b))
        return 2 if len(a) >= 3 and a == b else 3
    d = person_names.within(a, b, 2)
    if d is None or d > edits_allowed(max(len(a), len(b))):
        return 3
    return d


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


#: Surnames up to this length are compared many at a time; longer ones one by one.
_LONG = 40


def surname_levels(a: list[str], b: list[str]) -> np.ndarray:
    """surnames_agree of every pair, by one banded distance over arrays of letters."""
    out = np.full(len(a), 3)
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    odd = np.fromiter((x[:1] == "~" or y[:1] == "~" for x, y in zip(a, b, strict=True)), bool, len(a)) | (np.maximum(n, m) > _LONG)
    for i in np.flatnonzero(odd).tolist():
        out[i] = surnames_agree(a[i], b[i])
    at = np.flatnonzero(~odd & (np.abs(n - m) <= 2))
    if len(at):
        d = banded_distance([a[i] for i in at], [b[i] for i in at], n[at], m[at], 2)
        longer = np.maximum(n[at], m[at])
        out[at] = np.where(d <= np.where(longer < 5, 0, np.where(longer < 8, 1, 2)), d, 3)
    return out


def banded_distance(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Restricted Damerau-Levenshtein distances of pairs whose lengths differ by at most k; k+1 stands for more than k."""

    def letters(texts: list[str], sizes: np.ndarray, pad: int) -> np.ndarray:
        grid = np.full((len(texts), int(sizes.max(initial=0)) + 2 * k + 2), pad, np.int32)
        grid[:, k + 1 :][np.arange(grid.shape[1] - k - 1) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
        return grid.T.copy()  # grid[k + i] holds letter i, counted from 1

    x, y = letters(a, n, -1), letters(b, m, -2)
    far = np.full(len(a), k + 1, np.int32)
    # diagonal c of row i holds the distance of the first i letters of a and the first i + c - k of b
    row = [np.where(c - k <= m, c - k, k + 1).astype(np.int32) if c >= k else far for c in range(2 * k + 1)]
    before = [far] * (2 * k + 1)
    out = far.copy()

    def take(i: int, row: list[np.ndarray]) -> None:
        done = np.flatnonzero(n == i)
        if len(done):
            out[done] = np.stack(row)[m[done] - i + k, done]

    take(0, row)
    for i in range(1, int(n.max(initial=0)) + 1):
        new: list[np.ndarray] = []
        for c in range(2 * k + 1):
            j = i + c - k
            if j < 0 or k + j >= len(y):
                new.append(far)
                continue
            if j == 0:
                new.append(np.full(len(a), min(i, k + 1), np.int32))
                continue
            d = row[c] + (x[k + i] != y[k + j])
            if c < 2 * k:
                d = np.minimum(d, row[c + 1] + 1)
            if c:
                d = np.minimum(d, new[c - 1] + 1)
            if i > 1 and j > 1:
                d = np.where((x[k + i] == y[k + j - 1]) & (x[k + i - 1] == y[k + j]), np.minimum(d, before[c] + 1), d)
            new.append(np.minimum(d, k + 1).astype(np.int32))
        before, row = row, new
        take(i, row)
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("surname", "given", "middle")]))
def compare_names(sa: pd.Series, sb: pd.Series, ga: pd.Series, gb: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.DataFrame:
    known: dict[tuple[str, str], int] = {}
    sur, giv = surname_levels(list(sa), list(sb)), []
    for c, d in zip(ga, gb, strict=True):
        if (c, d) not in known:
            g = person_names.given_names_agree(c, d)
            known[c, d] = 3 if g is None else 3 - g
        giv.append(known[c, d])
    middle = np.where((ma != "") & (mb != ""), np.where(ma == mb, 0, 3), np.where((ma == "") & (mb == ""), 1, 2))
    return pd.DataFrame({"surname": sur, "given": giv, "middle": middle})


def _known(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0)


def compare_facts(occupation: Column, bucket: Column, country: Column, year: Column, c: dict[str, Column]) -> dict[str, Column]:
    """Levels of role, country and year of a request against a candidate's facts."""
    said_role = occupation.isNotNull() | bucket.isNotNull()
    known_role = _known(c["occupations"]) | _known(c["roles"])
    role = (
        F.when(~said_role | ~known_role, 2)
        .when(F.array_contains(F.coalesce(c["occupations"], F.array().cast("array<string>")), occupation), 0)
        .when(F.array_contains(F.coalesce(c["roles"], F.array().cast("array<string>")), bucket), 1)
        .otherwise(3)
    )
    place = F.when(country.isNull() | ~_known(c["citizenship"]), 1).when(F.array_contains(c["citizenship"], country), 0).otherwise(2)
    age = year - c["birth_year"]
    when = (
        F.when(year.isNull() | (c["birth_year"].isNull() & c["death_year"].isNull()), 2)
        .when(F.coalesce(year > c["death_year"] + 1, F.lit(False)) | F.coalesce(~age.between(11, 91), F.lit(False)), 3)
        .when(age.between(17, 71), 0)
        .otherwise(F.when(age.isNull(), 2).otherwise(1))
    )
    return {"role": role, "country": place, "year": when}


# -- expectation-maximisation ------------------------------------------------------------------------------------------


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, names: list[str], chance: dict[str, np.ndarray], rounds: int = 100) -> tuple[np.ndarray, float]:
    """(log likelihood ratio of every pattern, share of matches).

    ``chance`` has the levels of some comparisons among pairs at random; they anchor the class of non-matches, whose other
    chances are estimated along with those of the matches. Levels named in UNKNOWN keep a ratio of 1: that a fact is missing
    says nothing. Chances are smoothed by one pair.
    """

    def shares(c: np.ndarray, n: str) -> np.ndarray:
        c = c + 1.0
        if n in UNKNOWN:  # among the known levels only
            c[UNKNOWN[n]] = 0
            c = c / c.sum()
            c[UNKNOWN[n]] = 1
            return c
        return c / c.sum()

    m = {n: shares(np.array(START[n]) * 1000, n) for n in names}
    u = {n: shares(chance[n] if n in chance else np.bincount(patterns[:, i], counts, LEVELS[n]), n) for i, n in enumerate(names)}
    p = 0.5

    def ratio() -> np.ndarray:
        return sum((np.log(m[n]) - np.log(u[n]))[patterns[:, i]] for i, n in enumerate(names))

    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(ratio() + np.log(p / (1 - p)), -50, 50)))
        for i, n in enumerate(names):
            m[n] = shares(np.bincount(patterns[:, i], g * counts, LEVELS[n]), n)
            if n not in chance:
                u[n] = shares(np.bincount(patterns[:, i], (1 - g) * counts, LEVELS[n]), n)
        new = min(max(float((g * counts).sum() / counts.sum()), 1e-6), 1 - 1e-6)
        if abs(new - p) < 1e-7:
            break
        p = new
    return ratio(), p


def chance_levels(a: DataFrame, b: DataFrame) -> dict[str, np.ndarray]:
    """Numbers of pairs by level of role, country and year, if every profile of a (pa) met every profile of b (pb).

    No pair is made: how many profiles state what is counted on either side, and the counts are multiplied.
    """
    own = lambda c: F.when(_known(c), c).otherwise(F.array(F.lit(None).cast("string")))
    said = a.groupBy("pa.occupation", "pa.bucket").count().toPandas()  # entries of a list
    lands, years = a.groupBy("pa.country").count().toPandas(), a.groupBy("pa.year").count().toPandas()
    facts = b.select("pb.*", (_known(F.col("pb.occupations")) | _known(F.col("pb.roles"))).alias("role_known"))
    known = facts.agg(F.count(F.lit(1)).alias("n"), F.count_if("role_known").alias("role"), F.count_if(_known(F.col("citizenship"))).alias("country")).first()
    if not len(said) or not known.n:
        return {}
    # of each pair of an occupation and a bucket: how many state both, either
    both = facts.filter("role_known").select(F.explode(F.array_distinct(own(F.col("occupations")))).alias("o"), F.array_distinct(own(F.col("roles"))).alias("roles")).select("o", F.explode("roles").alias("b")).groupBy("o", "b").count().toPandas()
    alone = {c: dict(facts.select(F.explode(F.array_distinct(own(F.col(c)))).alias("x")).groupBy("x").count().toPandas().to_numpy().tolist()) for c in ("occupations", "roles", "citizenship")}
    pairs = {(o, x): n for o, x, n in both.to_numpy().tolist()}

    role = np.zeros(LEVELS["role"])
    for o, x, n in said.astype(object).where(said.notna(), None).to_numpy().tolist():
        if o is None and x is None:
            role[2] += n * known.n
            continue
        exact = alone["occupations"].get(o, 0) if o is not None else 0
        near = (alone["roles"].get(x, 0) if x is not None else 0) - (pairs.get((o, x), 0) if o is not None and x is not None else 0)
        role += n * np.array([exact, near, known.n - known.role, known.role - exact - near])
    country = np.zeros(LEVELS["country"])
    for c, n in lands.astype(object).where(lands.notna(), None).to_numpy().tolist():
        same = alone["citizenship"].get(c, 0) if c is not None else 0
        country += n * np.array([same, known.n - known.country, known.country - same] if c is not None else [0, known.n, 0])
    lives = facts.groupBy("birth_year", "death_year").count()  # pairs of years
    stated = _year_levels(lives, years)
    return {"role": role, "country": country, "year": stated}


def _year_levels(lives: DataFrame, years: pd.DataFrame) -> np.ndarray:
    """Numbers of pairs by level of year, of counted years of life and counted years asked for."""
    out = np.zeros(LEVELS["year"])
    held = lives.toPandas()
    birth, death, n = (held[c].to_numpy(float) for c in ("birth_year", "death_year", "count"))
    for y, k in years.to_numpy(float).tolist():
        age = y - birth
        with np.errstate(invalid="ignore"):
            apart = (y > death + 1) | (~np.isnan(age) & ~((age >= 11) & (age <= 91)))
            level = np.where(np.isnan(y) | (np.isnan(birth) & np.isnan(death)), 2, np.where(apart, 3, np.where((age >= 17) & (age <= 71), 0, np.where(np.isnan(age), 2, 1))))
        out += k * np.bincount(level, n, LEVELS["year"])
    return out


def scored(pairs: DataFrame, names: list[str], chance: dict[str, np.ndarray]) -> DataFrame:
    """Pairs with ``odds`` for a match, by EM over the patterns of the level columns ``names``."""
    counted = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most the product of LEVELS
    if counted.empty:
        return pairs.withColumn("odds", F.lit(0.0))
    patterns, counts = counted[names].to_numpy(int), counted["n"].to_numpy(float)
    weights, p = expectation_maximisation(patterns, counts, names, chance)
    table = counted[names].assign(odds=np.exp(np.clip(weights + np.log(p / (1 - p)), -30, 30)))
    told = pairs.sparkSession.createDataFrame(table)
    return pairs.join(F.broadcast(told.select(*[F.col(n).cast("int").alias(n) for n in names], "odds")), names)


FACTS = ["occupations", "roles", "birth_year", "death_year", "citizenship"]
ASKED = ["given", "surname", "middle", "occupation", "bucket", "country", "year"]
KNOWN = ["given", "surname", "middle", *FACTS]


def _may_be_one(a: Column, b: Column) -> Column:
    """Whether two candidate records may be of one person: no fact of one contradicts the other."""
    apart = F.coalesce(F.abs(a["birth_year"] - b["birth_year"]) > 2, F.lit(False))
    apart |= F.coalesce(F.abs(a["death_year"] - b["death_year"]) > 2, F.lit(False))
    for f in ("occupations", "citizenship"):
        apart |= _known(a[f]) & _known(b[f]) & ~F.arrays_overlap(a[f], b[f])
    apart |= ~(_known(a["occupations"]) & _known(b["occupations"])) & _known(a["roles"]) & _known(b["roles"]) & ~F.arrays_overlap(a["roles"], b["roles"])
    apart |= (a["middle"] != "") & (b["middle"] != "") & (a["middle"] != b["middle"])
    return ~apart


def decide(pairs: DataFrame, request: str, record: str, threshold: float = THRESHOLD) -> DataFrame:
    """The records of the one person each request most likely means: request, record, ``confidence``.

    ``pairs`` has ``odds``, a struct ``facts`` of FACTS and ``middle``, ``copies``, which is the number of records alike in these, and
    ``last``, which is one of them and decides between equal odds. The best record stands for its person; records that
    may be of that person stay and add their odds, all others are rivals, whose odds lower the confidence. Where namesakes are equally
    likely, none reaches the threshold of 0.5.
    """
    own = Window.partitionBy(request)  # one shuffle for all that is told of a request
    j = pairs.withColumn("best", F.max_by("facts", F.struct("odds", "last")).over(own)).withColumn("same", _may_be_one(F.col("facts"), F.col("best")))
    odds = lambda c: F.sum(F.when(c, F.col("odds") * F.col("copies")).otherwise(0.0)).over(own)
    j = j.select(request, record, "same", odds(F.col("same")).alias("own"), odds(~F.col("same")).alias("rivals"))
    j = j.filter("same").withColumn("confidence", F.col("own") / (1 + F.col("own") + F.col("rivals")))
    return j.filter(F.col("confidence") >= threshold).select(request, record, "confidence")


# -- linkage of requests to candidates ---------------------------------------------------------------------------------


def initial(given: Column) -> Column:
    """A class of first letters that may be one letter in another script or spelling."""
    return F.translate(F.substring(F.regexp_replace(given, "^~", ""), 1, 1), "eioucf", "aaaakp")


def initials(given: Column) -> Column:
    """The classes of first letters of all names that a given name may stand for: itself and those it is short for."""
    full = F.create_map(*[x for short, names in sorted(person_names._SHORT.items()) for x in (F.lit(short), F.array(*map(F.lit, sorted(names))))])
    return F.array_distinct(F.transform(F.concat(F.array(given), F.coalesce(F.try_element_at(full, given), F.array().cast("array<string>"))), initial))


def block_keys(given: Column, surname: Column) -> Column:
    """Keys of the blocking passes: the surname, its consonants, its beginning and its end, each with the given initials."""
    bare = F.regexp_replace(surname, "^~", "")
    bones = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[aeiou]", ""), "z", "j"), "jh", "j"), r"(.)\1+", "$1")
    passes = [(F.lit("whole"), surname), (F.lit("bones"), F.when(F.length(bones) >= 3, bones))]
    passes += [(F.lit(n), F.when(F.length(surname) >= 6, part)) for n, part in (("begin", F.substring(surname, 1, 5)), ("end", F.substring(surname, -5, 5)))]
    parts = F.array_compact(F.array(*[F.when(part.isNotNull(), F.concat_ws("|", n, part)) for n, part in passes]))
    keys = F.flatten(F.transform(initials(given), lambda first: F.transform(parts, lambda part: F.concat_ws("|", part, first))))
    # for requests whose given name is missing, and for candidates whose given name is
    return F.concat(keys, F.array(F.concat_ws("|", F.lit("only"), surname), F.concat_ws("|", F.lit("none"), surname)))


def link(requests: DataFrame, candidates: DataFrame, request: str, record: str) -> DataFrame:
    """request, record, ``confidence`` of every pair that matches.

    ``requests``: request, given, surname, middle, occupation, bucket, country, year; ``candidates``: record, given, surname,
    middle and FACTS. Any of them but the ids and surname may be null; a row given twice counts once; either table may be
    empty.
    """
    requests, candidates, a, b = profiles(requests, candidates, request, record)
    # keys and ids alone are shuffled; what they stand for is joined to the pairs that are left
    left = a.select("__a", F.col("pa.given").alias("given"), F.explode(block_keys(F.col("pa.given"), F.col("pa.surname"))).alias("key"))
    left = left.filter(~F.col("key").startswith("only|") | (F.col("given") == "")).select("__a", "key")
    right = b.select("__b", F.col("pb.given").alias("given"), F.explode(block_keys(F.col("pb.given"), F.col("pb.surname"))).alias("key"))
    right = right.filter(~F.col("key").startswith("none|") | (F.col("given") == "")).select("__b", "key")
    pairs = left.join(right, "key").select("__a", "__b").distinct().join(a, "__a").join(b, "__b")
    return matches(pairs, requests, candidates, a, b, request, record)


def profiles(requests: DataFrame, candidates: DataFrame, request: str, record: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ids of requests and their profiles, those of candidates, profiles of requests, profiles of candidates), all written to the shared folder."""
    requests, candidates = requests.dropDuplicates([request]).na.fill("", ["given", "middle"]), candidates.dropDuplicates([record]).na.fill("", ["given", "middle"])
    out = []
    for df, key, cols, at, whole in ((requests, request, ASKED, "a", "asked"), (candidates, record, KNOWN, "b", "known")):
        full = materialise(df.select(key, *cols).withColumn(f"__{at}", F.xxhash64(*cols)), "rows")
        # profiles are read by every step that follows, of the rows their ids only
        profile = materialise(full.select(f"__{at}", F.struct(*cols).alias(f"p{at}")).dropDuplicates([f"__{at}"]), whole)
        out.append((materialise(full.select(key, f"__{at}"), "ids"), profile))
        discard(full)
    (requests, a), (candidates, b) = out
    return requests, candidates, a, b


def matches(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, a: DataFrame, b: DataFrame, request: str, record: str) -> DataFrame:
    """From pairs of profiles (__a, pa, __b, pb) to pairs of rows that match."""
    # non-matches are namesakes: their chances are learnt from pairs whose names agree, not from those any two names would make
    pairs = compared(pairs, F.col("pa"), F.col("pb")).filter((F.col("surname") < 3) & (F.col("given") < 3))
    pairs = pairs.select("__a", "__b", *LEVELS)
    parts = [materialise(pairs.filter(F.pmod("__a", F.lit(ROUNDS)) == turn), "pairs") for turn in range(ROUNDS)]
    pairs = reduce(DataFrame.unionAll, parts)
    told = scored(pairs, list(LEVELS), chance_levels(a, b)).select("__a", "__b", "odds")
    held = candidates.groupBy("__b").agg(F.count(F.lit(1)).alias("copies"), F.max(record).alias("last"))
    facts = b.select("__b", F.struct(*[F.col(f"pb.{c}").alias(c) for c in (*FACTS, "middle")]).alias("facts"))
    matched = materialise(decide(told.join(facts.join(held, "__b"), "__b"), "__a", "__b"), "matched")  # profiles; rows come last
    discard(pairs, a, b)
    return requests.select(request, "__a").join(matched, "__a").join(candidates.select(record, "__b"), "__b").select(request, record, "confidence")


def compared(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs with the level columns of LEVELS."""
    pairs = pairs.withColumn("__n", compare_names(a["surname"], b["surname"], a["given"], b["given"], a["middle"], b["middle"]))
    facts = compare_facts(a["occupation"], a["bucket"], a["country"], a["year"], {f: b[f] for f in FACTS})
    return pairs.select("*", *[F.col(f"__n.{n}").alias(n) for n in ("surname", "given", "middle")], *[c.cast("int").alias(n) for n, c in facts.items()]).drop("__n")
