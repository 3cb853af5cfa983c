"""Reading uploaded sheets."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"
WORKBOOKS, TEXTS = ["xlsx", "xlsm", "xltx"], ["csv", "tsv", "txt"]


def sniff_delimiter(head: str) -> str:
    """The delimiter of a file by its first 4096 characters; a comma if it cannot be told."""
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, with or without a mark at its beginning, or else Latin-1, which all bytes are."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def upload_format(filename: Column, head: Column) -> Column:
    """``workbook`` or ``text``, by the ending of the name, or else by the first two bytes."""
    ending = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.when(ending.isin(WORKBOOKS), "workbook").when(ending.isin(TEXTS), "text").when(F.substring(head, 1, 2) == F.lit(b"PK"), "workbook").otherwise("text")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files, whole: ``path``, ``format``, ``text`` (of text files), ``error`` (of others: no reader for workbooks is installed).

    A file is one value, as uploads are small; large text files are for read_sheet.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("format", upload_format(F.col("path"), F.col("content")))
    text = F.col("format") == "text"
    return files.select("path", "format", F.when(text, decoded(F.col("content"))).alias("text"), F.when(~text, "workbooks cannot be read").alias("error"))


def read_sheet(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """A delimited file with a heading; delimiter and encoding are told by its first lines unless they are given."""
    if delimiter is None or encoding is None:
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("c")).first().c
        for known in ("utf-8-sig", "latin-1"):
            try:
                text = bytes(head[: len(head) - 4] if len(head) == 1 << 16 and known != "latin-1" else head).decode(known)
                break
            except UnicodeDecodeError:
                continue
        encoding = encoding or ("UTF-8" if known == "utf-8-sig" else "ISO-8859-1")
        delimiter = delimiter or sniff_delimiter(text)
    return spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
