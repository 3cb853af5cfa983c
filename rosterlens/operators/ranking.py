"""Scoring and ranking candidates for requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 0.25


def role_score(role: Column, country: Column, year: Column, roles: Column, citizenship: Column, birth: Column, death: Column, n_ids: Column) -> Column:
    """How well a candidate fits what a request says of role, country and year."""
    has = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    s = F.when(role.isNull(), 0.0).when(F.coalesce(F.array_contains(roles, role), F.lit(False)), 0.60).when(has(roles), -0.25).otherwise(0.0)
    s = s + F.when(country.isNull() | ~has(citizenship), 0.0).when(F.array_contains(citizenship, country), 0.15).otherwise(-0.10)
    age = year - birth
    s = s + F.when(year.isNull() | birth.isNull(), 0.0).when(age.between(12, 90), 0.15).otherwise(-0.30)
    s = s + F.when(F.coalesce(death < year, F.lit(False)), -0.40).otherwise(0.0)
    return F.round(s + F.lit(0.02) * F.least(n_ids, F.lit(6)), 3)


def label_penalty(score: Column, label_score: Column) -> Column:
    return F.round(score + (label_score - 1) * 0.5, 3)


def rank(candidates: DataFrame, request: str, score: str, order: str, margin: float = MARGIN) -> DataFrame:
    """One row a request: ``n``, ``top`` (its ``order``), ``top_score``, ``gap``, ``decision``.

    Candidates are first counted by score, of which a request has few different ones, since scores have three decimals;
    so a name that a third of all candidates share costs no more memory than any other, and candidates are read once.
    """
    same = candidates.groupBy(request, F.col(score).alias("__score")).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    best = F.max_by(F.struct(F.col("__first").alias("top"), F.col("__n").alias("ties")), "__score")
    j = same.groupBy(request).agg(F.sum("__n").alias("n"), F.max("__score").alias("top_score"), best.alias("__best"), F.sort_array(F.collect_list("__score"), asc=False).alias("__scores"))
    second = F.when(F.col("__best.ties") > 1, F.col("top_score")).otherwise(F.get("__scores", F.lit(1)))
    gap = F.round(F.col("top_score") - second, 3)
    decision = F.when(F.col("n") == 1, "resolved").when(F.col("top_score") <= 0, "disambiguate").when(gap >= margin, "resolved").otherwise("disambiguate")
    return j.select(request, "n", F.col("__best.top").alias("top"), "top_score", gap.alias("gap"), decision.alias("decision"))


def with_reason(ranked: DataFrame, role: Column) -> DataFrame:
    """ranked with the reason why a request without a role could not be decided; null for all others."""
    told = F.concat(F.col("n").cast("string"), F.lit(" people share this name and no role hint was supplied. Add an expected role and this usually resolves on its own."))
    return ranked.withColumn("reason", F.when((F.col("decision") == "disambiguate") & (F.coalesce(role, F.lit("")) == ""), told))


# Roles that a department's people may have.
DEPARTMENTS = {
    "Acting": ["actor", "comedian", "model"], "Directing": ["director"], "Writing": ["writer", "director"], "Production": ["director", "executive"],
    "Sound": ["musician"], "Crew": [],
}
SEARCH_MARGIN = 1.6


def person_score(popularity: Column, department: Column, role: Column, name: Column, asked: Column) -> Column:
    """How well a person found by name fits: popularity as a weak prior, the department's roles, the very name."""
    of = F.create_map(*[x for k, v in DEPARTMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    fits = F.coalesce(F.array_contains(F.try_element_at(of, department), role), F.lit(False))
    s = F.least(F.coalesce(popularity, F.lit(0.0)), F.lit(50.0)) / F.lit(50.0)
    s = s + F.when(F.coalesce(role, F.lit("")) == "", 0.0).when(fits, 1.0).otherwise(-0.5)
    return F.round(s + F.when(F.lower(F.trim(F.coalesce(name, F.lit("")))) == F.lower(F.trim(asked)), 0.3).otherwise(0.0), 3)


def rank_people(found: DataFrame, request: str, score: str, order: str) -> DataFrame:
    """One row a request: ``n``, ``person`` (null unless resolved), ``gap``, ``decision`` over people found by name.

    A single one is taken; else the best must be above 0 and lead by the search margin less one.
    """
    r = rank(found, request, score, order)
    clear = (F.col("n") == 1) | ((F.col("top_score") > 0) & (F.col("gap") >= F.lit(SEARCH_MARGIN) - F.lit(1.0)))
    return r.select(request, "n", F.when(clear, F.col("top")).alias("person"), "gap", F.when(clear, "resolved").otherwise("ambiguous").alias("decision"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. The window's group limit keeps k rows a group from each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in ascending ``order``, which must settle all ties."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*by, "__b.*")
