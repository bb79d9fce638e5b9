"""A catalog of data sources: what each is, and whether it may be used."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("name", "origin", "license", "size", "format", "fields", "status", "reason")
INCLUDE, EXCLUDE = "INCLUDE", "EXCLUDE"


def catalog(spark: SparkSession, entries: Iterable[dict[str, str]]) -> DataFrame:
    """One row for each entry; fields that an entry lacks are null."""
    return spark.createDataFrame([tuple(e.get(c) for c in COLUMNS) for e in entries], ", ".join(f"{c} string" for c in COLUMNS))


def usable(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("status") == INCLUDE)


def excluded(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("status") == EXCLUDE)
