"""Batch stamping, cleaning and simple selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions.text import feed_query
from storyline.functions.times import parse_published
from storyline.operators.skew import dense_row_id, first_per_key


def stamp_batch(
    df: DataFrame, batch: Column, model_name: str, model_version: str, topic: Column | None = None
) -> DataFrame:
    """Attach topic, query text, run names and the batch stamp."""
    if topic is not None:
        df = df.withColumn("topic", topic)
    return df.withColumns(
        {
            "query": feed_query(F.col("topic")),
            "model_name": F.lit(model_name),
            "model_version": F.lit(model_version),
            "batch_query_time": batch.cast("bigint"),
        }
    )


def restamp(df: DataFrame, batch: Column) -> DataFrame:
    """Keep the old stamp under a new name and set a new one; both read the old value."""
    return df.withColumns(
        {
            "step1_batch_query_time": F.col("batch_query_time"),
            "batch_query_time": batch.cast("bigint"),
        }
    )


def union_frames(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    """Union by name with nulls for missing columns; ``empty`` when there are no frames."""
    if not frames:
        return empty
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_published(df: DataFrame, text: str = "publishedAt") -> DataFrame:
    return df.withColumn(text, parse_published(F.col(text)))


def bad_timestamps(df: DataFrame, text: str) -> DataFrame:
    """Number of rows whose timestamp text is present but cannot be read."""
    bad = F.col(text).isNotNull() & parse_published(F.col(text)).isNull()
    return df.agg(F.count_if(bad).alias("bad_rows"))


def clean_articles(news: DataFrame, batch: Column, order_by: list[str] | None = None) -> DataFrame:
    """Typed, stamped, first per (url, topic), with a dense id.

    Rows equal in the given order are told apart by a hash of the whole row, so the
    pick and the ids are the same at every run; rows of one hash are equal.
    """
    order = [*(order_by or ["publishedAt", "url", "topic"]), "_row"]
    typed = with_published(restamp(news, batch))
    typed = typed.withColumn("_row", F.xxhash64(F.to_json(F.struct(*typed.columns))))
    return dense_row_id(first_per_key(typed, ["url", "topic"], order), order).drop("_row")


def limit_or_all(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """First ``n`` rows in order; every row when ``n`` is not positive."""
    return df.orderBy(order_by).limit(n) if n > 0 else df


def row_lookup(df: DataFrame, key: str, value: int, columns: list[str]) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).select(*columns)
