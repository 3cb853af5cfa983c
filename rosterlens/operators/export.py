"""The flat result sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import PLATFORMS


def pivot_accounts(claims: DataFrame, entity: str) -> DataFrame:
    """One row an entity: a column for each platform with its accepted accounts, and ``needs_review``.

    Pivoted by conditional aggregation in one pass; the platforms are fixed.
    """
    listed = lambda p: F.array_join(F.array_sort(F.collect_set(F.when((F.col("verdict") == "accept") & (F.col("platform") == p), F.col("handle")))), " | ")
    review = F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") == "review", F.concat("platform", F.lit(":"), "handle")))), " | ")
    return claims.groupBy(entity).agg(*[listed(p).alias(p) for p in PLATFORMS], review.alias("needs_review"))


#: The columns of the result sheet, in their order.
COLUMNS = ["row_id", "name", "decision", "entity_id", "label", "roles", "coverage", "label_match", *PLATFORMS, "needs_review", "spoke_ids", "alternates", "notes"]


def accepted(claims: DataFrame, entity: str, order: str) -> DataFrame:
    """entity, ``platform``, ``handles``: accepted accounts in the order they were claimed, each once."""
    first = claims.filter("verdict = 'accept'").groupBy(entity, "platform", "handle").agg(F.min(order).alias("__o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__o", "handle"))), lambda x: x["handle"])
    return first.groupBy(entity, "platform").agg(F.array_join(listed, " | ").alias("handles"))


def sheet(df: DataFrame) -> DataFrame:
    """df as the result sheet: its columns in their order, as text, empty where there is nothing; further columns are left out."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in COLUMNS])


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """A CSV with a heading, partition by partition: no row passes the driver. With ``mark`` each file begins with that of UTF-8."""
    out = df.toDF(*[("\ufeff" if mark and i == 0 else "") + c for i, c in enumerate(df.columns)])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
