"""Counts that describe a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return group_counts(df, *keys).where("n > 1")


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return group_counts(df, column).orderBy(F.desc("n"), column)


def success_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )
