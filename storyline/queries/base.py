"""Shared inputs of the queries: table roles, and stages stored once per session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.text import after_first_line, first_line
from storyline.session import materialize
from storyline.sources.tables import spread

AS_OF_TEXT = "2024-01-31 00:00:00"
# articles carry the first events' times, so their pages are read early in the month
PAGE_AS_OF_TEXT = "2024-01-03 00:00:00"
FEED_AS_OF_TEXT = "2024-01-16 00:00:00"
MODEL_NAME = "story-feed"
MODEL_VERSION = "v1"
LANGUAGES = ["de", "en", "es", "fr"]

_stages: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for row-local text work, spread over the cores if the file is one piece."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id")


def stage(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame],
    store: bool = True,
) -> DataFrame:
    """A stage shared by several queries: built and stored once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        built = build(spark, sf_dir)
        _stages[key] = materialize(built, name) if store else built
    return _stages[key]


def forget_stages() -> None:
    _stages.clear()


def as_of(text: str = AS_OF_TEXT):
    return F.lit(text).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed batches: one batch per day."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").withColumns(
        {"ts": ts, "batch_query_time": F.unix_seconds(F.date_trunc("day", ts))}
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         epoch(date_trunc('day', ts))::BIGINT AS batch_query_time
  FROM events
)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: documents with their label as sentiment and an event time by id."""
    # the text is taken apart before the joins, so that they move only what is asked for
    docs = texts(spark, sf_dir, "lang", "source").select(
        "doc_id", "lang", "source", first_line(F.col("text")).alias("headline"), after_first_line(F.col("text")).alias("summary")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    times = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("publishedAt")
    )
    number = F.col("doc_id")
    return (
        docs.join(labels, "doc_id", "left")
        .join(times, "doc_id", "left")
        .select(
            number.alias("id"),
            F.struct(F.lit(None).cast("string").alias("id"), F.col("source").alias("name")).alias("source"),
            F.concat(F.lit("by "), F.col("source")).alias("author"),
            "headline",
            "summary",
            F.when(number % 7 == 1, F.concat(F.lit("plain "), F.col("lang")))
            .when(number % 7 == 2, F.lit(None))
            .when(number % 7 == 3, F.lit("[]"))
            .otherwise(F.concat(F.lit('["'), F.col("lang"), F.lit('", "'), F.col("source"), F.lit('"]')))
            .alias("keywords"),
            F.when(F.col("quality") == 1, "positive")
            .when(F.col("quality") == 0, "negative")
            .otherwise("MIXED view")
            .alias("sentiment"),
            "publishedAt",
            F.when(number % 10 == 0, F.lit(None))
            .when(number % 10 == 1, F.lit(""))
            .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), number.cast("string")))
            .alias("url"),
            F.col("lang").alias("topic"),
        )
    )


ARTICLES_SQL = r"""
art AS (
  SELECT d.doc_id AS id, d.source, 'by ' || d.source AS author,
         split_part(d.text, chr(10), 1) AS headline,
         CASE WHEN contains(d.text, chr(10)) THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS summary,
         CASE d.doc_id % 7 WHEN 1 THEN 'plain ' || d.lang WHEN 2 THEN NULL WHEN 3 THEN '[]'
              ELSE '["' || d.lang || '", "' || d.source || '"]' END AS keywords,
         CASE d.doc_id % 7 WHEN 1 THEN 'plain ' || d.lang WHEN 2 THEN NULL WHEN 3 THEN ''
              ELSE '`' || d.lang || '`, `' || d.source || '`' END AS keywords_shown,
         CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'MIXED view' END AS sentiment,
         e.ts AS published_at,
         CASE d.doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN ''
              ELSE 'https://' || d.source || '.example/' || d.doc_id END AS url,
         d.lang AS topic
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN events e ON e.event_id = d.doc_id
)"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    """A WITH clause of several named parts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip() for p in parts) + "\n"
