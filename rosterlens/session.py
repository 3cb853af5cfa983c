"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rosterlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) a local one.

    On a cluster the setting must name shared storage; only a local master may fall back to a folder of this machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "rosterlens-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within are deleted when it has run, not when the driver next collects its garbage.

    What is planned within must be run once only, and only within.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut and the files survive a lost executor.

    The write plans df anew, so that only its own shuffle files are deleted with it.
    """
    spark = df.sparkSession
    at = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rosterlens-{spark.sparkContext.applicationId}"


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing will be read from again; other files are never touched."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        own = path(_own_folder(spark)).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = path(folder)
            if at.getParent().toUri().getPath() == own:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has materialised. DataFrames made before cannot be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
