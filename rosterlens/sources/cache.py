"""Fetched answers as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import alive, latest


def cached(cache: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """The latest answer for each URL, if it is younger than the time to live."""
    return alive(latest(cache, ["url_hash"], ["fetched_at"]), "fetched_at", as_of, ttl_seconds)


def fetch(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Requests with the answers the cache has for their URLs; null where it has none."""
    return requests.withColumn("url_hash", F.sha2(F.col(url), 256)).join(cache.drop("url"), "url_hash", "left")


def fixture(requests: DataFrame, fixtures: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Requests with the answer of the first fixture (part of a URL, answer) that their URL contains."""
    answer = F.coalesce(*[F.when(F.col(url).contains(needle), F.lit(body)) for needle, body in fixtures]) if fixtures else F.lit(None).cast("string")
    return requests.withColumn("body", answer)
