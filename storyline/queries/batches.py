"""Batches, the feed and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions.times import batch_stamp, is_new, lower_date_bound
from storyline.operators import profile
from storyline.operators.clean import restamp, stamp_batch, union_frames
from storyline.operators.skew import dense_row_id
from storyline.queries.base import (
    AS_OF_TEXT, EVENTS_SQL, FEED_AS_OF_TEXT, MODEL_NAME, MODEL_VERSION, as_of, events, table, texts, with_sql,
)
from storyline.session import scratch_path
from storyline.sources import feed, tables

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "batch_query_time"]


def latest_batch_value(spark, sf_dir):
    return tables.latest_batch_value(events(spark, sf_dir))


def latest_batch_snapshot(spark, sf_dir):
    return tables.latest_batch(events(spark, sf_dir)).select(*EVENT_COLUMNS)


def append_then_latest(spark, sf_dir):
    """Two appends, the second with its columns in another order; then the newest batch."""
    rows = events(spark, sf_dir).select(*EVENT_COLUMNS)
    path = scratch_path(spark, "append")
    middle = F.lit("2024-01-16").cast("timestamp")
    early = F.coalesce(F.col("batch_query_time") < F.unix_seconds(middle), F.lit(False))
    tables.write_batch(rows.where(early), path)
    tables.write_batch(rows.where(~early).select(*sorted(EVENT_COLUMNS)), path)
    return tables.read_latest(spark, path, rows.schema).select(*EVENT_COLUMNS)


def overwrite_roundtrip(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    path = scratch_path(spark, "overwrite")
    tables.write_table(rows.withColumn("value", -F.col("value")), path, "overwrite")
    tables.write_table(rows, path, "overwrite")
    return tables.read_table(spark, path, rows.schema)


def batch_stamp_union(spark, sf_dir):
    """Stamped rows of all topics, those of two topics from a frame without the value column."""
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    without = F.coalesce(F.col("event_type").isin("error", "signup"), F.lit(False))
    frames = [
        stamp_batch(frame, batch_stamp(as_of()), MODEL_NAME, MODEL_VERSION, F.col("event_type")).drop("event_type")
        for frame in (rows.where(~without), rows.where(without).drop("value"))
    ]
    return union_frames(frames, rows.limit(0))


def batch_restamp(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "batch_query_time")
    return restamp(rows, batch_stamp(as_of()))


def feed_top_n_per_topic(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "ts")
    return feed.newest_per_topic(rows, "event_type", "ts", "event_id").select("event_id", "event_type")


def topic_counts(spark, sf_dir):
    return profile.group_counts(events(spark, sf_dir), "event_type")


def is_new_flag(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", is_new(F.col("ts"), as_of()).alias("is_new"))


def dense_id(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id")
    return dense_row_id(rows, ["ts", "event_id"]).select("id", "event_id", "user_id")


def feed_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    times = events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), "ts")
    rows = feed.in_window(docs.join(times, "doc_id"), "ts", "lang", as_of(FEED_AS_OF_TEXT))
    return rows.orderBy(F.desc("ts"), "doc_id").select(
        "doc_id", "source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"),
        lower_date_bound(as_of(FEED_AS_OF_TEXT)).alias("from_date"),
    )


FEED_TERMS = ["The", "in"]


def feed_term_filter(spark, sf_dir):
    docs = texts(spark, sf_dir, "lang")
    return feed.matching_terms(docs, FEED_TERMS, "text").select("doc_id", "lang")


QUERIES = {
    "latest_batch_value": latest_batch_value,
    "latest_batch_snapshot": latest_batch_snapshot,
    "append_then_latest": append_then_latest,
    "overwrite_roundtrip": overwrite_roundtrip,
    "batch_stamp_union": batch_stamp_union,
    "batch_restamp": batch_restamp,
    "feed_top_n_per_topic": feed_top_n_per_topic,
    "topic_counts": topic_counts,
    "is_new_flag": is_new_flag,
    "dense_row_id": dense_id,
    "feed_scan": feed_scan,
    "feed_term_filter": feed_term_filter,
}

_LATEST = with_sql(EVENTS_SQL) + """
SELECT event_id, user_id, event_type, value, batch_query_time FROM ev
WHERE batch_query_time = (SELECT max(batch_query_time) FROM ev)"""

SQL = {
    "latest_batch_value": with_sql(EVENTS_SQL) + "SELECT DISTINCT batch_query_time FROM ev ORDER BY 1 DESC LIMIT 1",
    "latest_batch_snapshot": _LATEST,
    "append_then_latest": _LATEST,
    "overwrite_roundtrip": "SELECT event_id, user_id, event_type, value FROM events",
    "batch_stamp_union": f"""
SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value,
       event_type AS topic, 'Australian ' || event_type AS query,
       '{MODEL_NAME}' AS model_name, '{MODEL_VERSION}' AS model_version,
       epoch(TIMESTAMP '{AS_OF_TEXT}')::BIGINT AS batch_query_time
FROM events""",
    "batch_restamp": with_sql(EVENTS_SQL) + f"""
SELECT event_id, batch_query_time AS step1_batch_query_time,
       epoch(TIMESTAMP '{AS_OF_TEXT}')::BIGINT AS batch_query_time FROM ev""",
    "feed_top_n_per_topic": """
SELECT event_id, event_type FROM (
  SELECT event_id, event_type,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
WHERE rn <= 100""",
    "topic_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "is_new_flag": f"""
SELECT event_id, epoch_us(TIMESTAMP '{AS_OF_TEXT}') - epoch_us(ts) < 86400000000 AS is_new FROM events""",
    "dense_row_id": """
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS id, event_id, user_id FROM events""",
    "feed_scan": f"""
SELECT d.doc_id, d.source, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS published,
       strftime(DATE '{FEED_AS_OF_TEXT[:10]}' - INTERVAL 14 DAY, '%Y-%m-%d') AS from_date
FROM documents d JOIN events e ON e.event_id = d.doc_id
WHERE d.lang = 'en' AND e.ts >= DATE '{FEED_AS_OF_TEXT[:10]}' - INTERVAL 14 DAY""",
    "feed_term_filter": r"""
SELECT doc_id, lang FROM documents
WHERE list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'the')
  AND list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'in')""",
}
