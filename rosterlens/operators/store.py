"""Keyed state kept as appended rows: latest wins, time to live, registries, cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last in ``order``: an upsert over appended rows, by hash aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same keys; changes has each key once."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def alive(df: DataFrame, stamp: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows younger than a time to live."""
    return df.filter((F.unix_micros(as_of) - F.unix_micros(F.col(stamp))) < seconds * 1_000_000)


def collisions(df: DataFrame, name: str, role_array: str) -> DataFrame:
    """Names that several rows share, with their number and their roles, sorted and joined with commas."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("n_candidates")).filter("n_candidates > 1")
    roles = df.select(name, F.explode_outer(role_array).alias("role")).groupBy(name).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    return n.join(roles, name)


def gaps(df: DataFrame, by: str, order: list[str], least_seconds: Column) -> DataFrame:
    """Rows that follow the one before them in their group sooner than allowed, with the seconds between; the first of order is the time."""
    w = Window.partitionBy(by).orderBy(*order)
    micros = F.unix_micros(F.col(order[0]))
    return df.withColumn("gap", (micros - F.lag(micros).over(w)) / 1e6).filter(F.col("gap") < least_seconds)


def fallback(stages: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first stage that has any, with its number as ``stage``."""
    every = None
    for i, s in enumerate(stages):
        x = s.withColumn("stage", F.lit(i))
        every = x if every is None else every.unionByName(x)
    first = every.groupBy(key).agg(F.min("stage").alias("stage"))
    return every.join(first, [key, "stage"])


def batch_split(df: DataFrame, group: str, order: list[str], most: int, valid: Column) -> DataFrame:
    """``status`` of each row: skipped (not valid), processed (among the first ``most`` valid ones of its group), unprocessed."""
    w = Window.partitionBy(group, valid).orderBy(*order)
    return df.withColumn("status", F.when(~valid, "skipped").when(F.row_number().over(w) <= most, "processed").otherwise("unprocessed"))
