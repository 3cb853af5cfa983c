"""Jobs and their rows as appended events: the latest of each counts, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import latest

# States in which a job has ended.
ENDED = ["done", "failed", "cancelled"]


def job_rows(events: DataFrame) -> DataFrame:
    """The latest payload of every row of a job: job_id, seq, payload. events: job_id, seq, payload, ``at``."""
    return latest(events, ["job_id", "seq"], ["at"]).drop("at")


def job_output(events: DataFrame, job: str) -> DataFrame:
    """A job's rows in their order."""
    return job_rows(events.filter(F.col("job_id") == job)).select("seq", "payload").orderBy("seq")


def status(created: DataFrame, states: DataFrame, rows: DataFrame) -> DataFrame:
    """job_id, state, filename, total, processed, percent, started_at, finished_at, error of every job.

    created: job_id, filename, total, started_at; states: job_id, state, error, ``at``; rows: as for job_rows. A job without a
    state is queued; the percentage of an empty job is 0.
    """
    now = states.groupBy("job_id").agg(F.max_by(F.struct("state", "error", F.when(F.col("state").isin(ENDED), F.col("at")).alias("finished_at")), "at").alias("s"))
    done = rows.groupBy("job_id").agg((F.max("seq") + 1).alias("processed"))
    j = created.join(now, "job_id", "left").join(done, "job_id", "left")
    processed = F.coalesce("processed", F.lit(0))
    percent = F.when(F.coalesce("total", F.lit(0)) > 0, F.round(F.lit(100.0) * processed / F.col("total"), 1)).otherwise(0.0)
    return j.select("job_id", F.coalesce("s.state", F.lit("queued")).alias("state"), "filename", F.coalesce("total", F.lit(0)).alias("total"), processed.alias("processed"), percent.alias("percent"), "started_at", F.col("s.finished_at").alias("finished_at"), F.col("s.error").alias("error"))


def recent(jobs: DataFrame, most: int = 20) -> DataFrame:
    """The jobs started last."""
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(most)


def append(df: DataFrame, path: str) -> None:
    """Events are only ever appended."""
    df.write.mode("append").parquet(path)
