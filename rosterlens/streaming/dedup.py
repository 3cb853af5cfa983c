"""Streams: deduplication with a time to live, and windowed counts of late data. An extension of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(stream: DataFrame, keys: list[str], stamp: str, ttl: str = "7 days") -> DataFrame:
    """Each key once within the time to live; state older than the watermark is dropped."""
    return stream.withWatermark(stamp, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, stamp: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), *by).count()
