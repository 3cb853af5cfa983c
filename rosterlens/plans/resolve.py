"""The whole resolution of requests against candidates as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import ranking


def with_normal(df: DataFrame, text: str, name: str = "normal", marks: bool = True) -> DataFrame:
    """df with the normal form of a name; rows in plain ASCII stay in the JVM, the others pass the UDF that strips marks."""
    if not marks:
        return df.withColumn(name, names.normalize_stripped(F.col(text)))
    plain = F.coalesce(F.col(text), F.lit("")).rlike(r"^[\x00-\x7f]*$")
    a = df.filter(plain).withColumn(name, names.normalize_stripped(F.col(text)))
    return a.unionByName(df.filter(~plain).withColumn(name, names.normalize(F.col(text))))


def spellings(text: Column, normal: Column) -> Column:
    """The normal forms under which a name is looked up, or found: those of its variants."""
    told = names.variants(text, normal, normal)
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(normal), F.slice(told, 2, 10)), lambda v: F.when(v == F.trim(text), normal).otherwise(names.normalize_stripped(v))), lambda v: v != ""))


def recall(requests: DataFrame, request: str, name: str, candidates: DataFrame, record: str, label: str, marks: bool = True, every: bool = True) -> DataFrame:
    """Pairs of requests and candidates that share a spelling, each once: with ``every`` that of any variant, else the normal or initials form."""

    def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
        n = with_normal(df.select(key, text).dropDuplicates([key]), text, "__n", marks).filter("__n <> ''")
        told = spellings(F.col(text), F.col("__n")) if every else F.array_distinct(F.array("__n", names.initials_form(F.col("__n"))))
        return n.select(key, F.explode(told).alias("__spelling"))

    return keyed(requests, request, name).join(keyed(candidates, record, label), "__spelling").select(request, record).distinct()


def matched(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, request: str, record: str, name: str, label: str, marks: bool = True) -> DataFrame:
    """pairs with all columns of both sides, ``label_score`` and ``how`` the two names agree."""
    a = with_normal(requests.dropDuplicates([request]), name, "__na", marks)
    b = with_normal(candidates.dropDuplicates([record]), label, "__nb", marks)
    j = names.with_match(pairs.join(a, request).join(b, record), name, label, "__na", "__nb", "__match")
    return j.select("*", F.col("__match.score").alias("label_score"), F.col("__match.how").alias("how")).drop("__match", "__na", "__nb")


def rejected(matches: DataFrame, request: str, record: str, label: str) -> DataFrame:
    """The pairs whose names agree too little to be considered, with the reason."""
    return matches.filter(F.col("label_score") < names.LABEL_FLOOR).select(request, record, F.lit("label mismatch").alias("why"), F.col("label_score").alias("score"), F.col(label).alias("closest"))


def scored(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, request: str, record: str, name: str, label: str, marks: bool = True) -> DataFrame:
    """Pairs with label score and role score; those under the label floor are left out (see rejected).

    requests: role, country, year; candidates: roles, citizenship, birth_year, death_year, external_ids.
    """
    j = matched(pairs, requests, candidates, request, record, name, label, marks)
    s = ranking.role_score(F.col("role"), F.col("country"), F.col("year"), F.col("roles"), F.col("citizenship"), F.col("birth_year"), F.col("death_year"), F.coalesce(F.size(F.map_keys("external_ids")), F.lit(0)))
    j = j.filter(F.col("label_score") >= names.LABEL_FLOOR)
    return j.withColumn("role_score", ranking.label_penalty(s, F.col("label_score"))).select(request, record, "label_score", "how", "role_score")


def best_labels(labels: DataFrame, key: str, name: str, label: str, place: str, marks: bool = True) -> DataFrame:
    """Of each key the label that agrees best with its name, the first of equals: key, ``label``, ``score``, ``how``.

    labels: key, name, label, place. Where no label agrees at all the score is 0 and how is ``none``.
    """
    j = with_normal(with_normal(labels, name, "__na", marks), label, "__nb", marks)
    j = names.with_match(j, name, label, "__na", "__nb", "__match")
    best = j.groupBy(key).agg(F.max_by(F.struct(F.col(label).alias("label"), "__match"), F.struct(F.col("__match.score"), -F.col(place))).alias("b"))
    some = F.col("b.__match.score") > 0
    return best.select(key, F.when(some, F.col("b.label")).otherwise(F.lit("")).alias("label"), F.col("b.__match.score").alias("score"), F.when(some, F.col("b.__match.how")).otherwise(F.lit("none")).alias("how"))
