"""Cleaning, keys, text layout and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions import text as X
from storyline.functions.times import parse_published
from storyline.operators import clean, profile
from storyline.operators.callback import embeddable
from storyline.operators.rank import articles_by_topic
from storyline.operators.skew import first_per_key
from storyline.queries.base import table


def timestamp_parse(spark, sf_dir):
    """Event times as text in three layouts, every seventh one unreadable."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no time "), F.col("event_id")))
        .when(F.col("event_id") % 7 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 7 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return rows.select("event_id", F.unix_seconds(parse_published(text)).alias("published"))


def timestamp_bad_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("published")
    )
    return clean.bad_timestamps(rows, "published")


def dedup_url_topic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return first_per_key(docs, ["text", "lang"], ["doc_id"]).select("doc_id", "lang")


def dedup_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    )
    return first_per_key(pages, ["host"], ["page_id"])


def duplicate_keys_having(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return profile.duplicate_keys(docs, "lang", "text").select("lang", F.md5("text").alias("text_md5"), "n")


def _titled(spark, sf_dir):
    text = F.col("text")
    rest = X.after_first_line(text)
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", text,
        X.first_line(text).alias("title"),
        F.when(rest != "", rest).alias("description"),
    )


def embeddable_rows(spark, sf_dir):
    """Titles, blanked or missing for some rows, that can be embedded."""
    title = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise(F.col("title"))
    return embeddable(_titled(spark, sf_dir).withColumn("title", title)).select("doc_id", "title")


def limit_or_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return clean.limit_or_all(docs, 50, "doc_id")


def row_lookup(spark, sf_dir):
    return clean.row_lookup(_titled(spark, sf_dir), "doc_id", 2, ["title", "description", "lang"])


def article_text(spark, sf_dir):
    content = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("text"))
    whole = X.article_text(F.col("title"), F.col("description"), content)
    return _titled(spark, sf_dir).select("doc_id", F.md5(whole).alias("md5"), F.length(whole).alias("n"))


def combined_text(spark, sf_dir):
    parts = (F.col("title"), F.col("description"))
    return _titled(spark, sf_dir).select(
        "doc_id", F.md5(X.combined_text(*parts)).alias("combined_md5"),
        F.md5(X.document_text(*parts)).alias("document_md5"),
    )


def doc_title(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_id", "title")


def _categorized(spark, sf_dir):
    """Category text: the language, and a second language by the source number."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    second = F.when(number % 2 == 0, "en").otherwise("de")
    text = F.concat(F.lit('["'), F.col("lang"), F.lit('", "'), second, F.lit('"]'))
    text = F.when(number == 7, F.lit("[]")).when(number == 9, F.lit(None)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("categories"))


def category_parse(spark, sf_dir):
    return _categorized(spark, sf_dir).select(
        "doc_id", F.array_join(X.parse_categories(F.col("categories")), "|").alias("categories")
    )


def category_parse_parity(spark, sf_dir):
    return _categorized(spark, sf_dir).select(
        "doc_id", F.array_join(X.parse_categories_untrimmed(F.col("categories")), "|").alias("categories")
    )


def category_membership(spark, sf_dir):
    rows = _categorized(spark, sf_dir).withColumn("categories", X.parse_categories(F.col("categories")))
    topics = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("topic")).distinct()
    return articles_by_topic(rows, "categories", topics).select("doc_id", "topic")


QUERIES = {
    "timestamp_parse": timestamp_parse,
    "timestamp_bad_rows": timestamp_bad_rows,
    "dedup_url_topic": dedup_url_topic,
    "dedup_url": dedup_url,
    "duplicate_keys_having": duplicate_keys_having,
    "embeddable_rows": embeddable_rows,
    "limit_or_all": limit_or_all,
    "row_lookup": row_lookup,
    "article_text": article_text,
    "combined_text": combined_text,
    "doc_title": doc_title,
    "category_parse": category_parse,
    "category_parse_parity": category_parse_parity,
    "category_membership": category_membership,
}

_TITLED = """
WITH t AS (
  SELECT doc_id, lang, text, split_part(text, chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 AND instr(text, chr(10)) < length(text)
              THEN substr(text, instr(text, chr(10)) + 1) END AS description
  FROM documents)
"""

_CATEGORIES = """
WITH s AS (
  SELECT doc_id, lang, regexp_extract(source, '[0-9]+')::INT AS number FROM documents),
c AS (
  SELECT doc_id, lang, number, CASE WHEN number % 2 = 0 THEN 'en' ELSE 'de' END AS second FROM s)
"""

SQL = {
    "timestamp_parse": """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT END AS published
FROM events""",
    "timestamp_bad_rows": "SELECT count(*) AS bad_rows FROM events WHERE event_id % 7 = 0",
    "dedup_url_topic": """
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""",
    "dedup_url": """
SELECT page_id, url, host FROM (
  SELECT page_id, url, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn
  FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages))
WHERE rn = 1""",
    "duplicate_keys_having": """
SELECT lang, md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY lang, text HAVING count(*) > 1""",
    "embeddable_rows": _TITLED + "SELECT doc_id, title FROM t WHERE doc_id % 5 NOT IN (0, 1) AND title <> ''",
    "limit_or_all": "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "row_lookup": _TITLED + "SELECT title, description, lang FROM t WHERE doc_id = 2",
    "article_text": _TITLED + """
SELECT doc_id, md5(whole) AS md5, length(whole) AS n FROM (
  SELECT doc_id, 'Title: ' || title || chr(10) || chr(10) || 'Description: ' || coalesce(description, 'None')
         || chr(10) || chr(10) || 'Content: ' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE text END AS whole
  FROM t)""",
    "combined_text": _TITLED + """
SELECT doc_id, md5(title || chr(10) || chr(10) || description) AS combined_md5,
       md5(title || chr(10) || chr(10) || coalesce(description, 'None')) AS document_md5 FROM t""",
    "doc_title": _TITLED + "SELECT doc_id, title FROM t",
    "category_parse": _CATEGORIES + """
SELECT doc_id, CASE number WHEN 9 THEN NULL WHEN 7 THEN '' ELSE lang || '|' || second END AS categories FROM c""",
    "category_parse_parity": _CATEGORIES + """
SELECT doc_id, CASE number WHEN 9 THEN NULL WHEN 7 THEN '' ELSE lang || '| ' || second END AS categories FROM c""",
    "category_membership": _CATEGORIES + """
SELECT DISTINCT doc_id, topic FROM (
  SELECT doc_id, number, unnest([lang, second]) AS topic FROM c)
WHERE number NOT IN (7, 9)""",
}
