"""Batch readers of raw lines and of landed requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def read_lines(spark: SparkSession, path: str | list[str], max_bytes: int = S.TAIL_MAX_LINE) -> DataFrame:
    """Lines of files or globs (``value``, ``_path``): one CR stripped, empty and over-long lines left out."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_path", F.col("_metadata.file_path"))
    return clean_lines(lines, max_bytes)


def clean_lines(lines: DataFrame, max_bytes: int | None = S.TAIL_MAX_LINE, column: str = "value") -> DataFrame:
    out = lines.withColumn(column, F.regexp_replace(column, "\\r\\z", "")).where(F.col(column) != "")
    return out if max_bytes is None else out.where(F.octet_length(column) <= max_bytes)


def split_lines(df: DataFrame, text: Column, position: str = "_pos", column: str = "value") -> DataFrame:
    """A row a line of a text column, in order."""
    rest = df.columns
    return clean_lines(df.select(*rest, F.posexplode(F.split(text, "\n")).alias(position, column)), None, column)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies that were landed as files, one JSON document a file or line."""
    return spark.read.schema(S.INGEST_REQUEST).option("mode", "DROPMALFORMED").json(path)
