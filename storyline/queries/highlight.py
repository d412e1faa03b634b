"""Exports and highlight pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import constants as C
from storyline.operators import highlights, rank
from storyline.queries.base import ARTICLES_SQL, PAGE_AS_OF_TEXT, articles, as_of
from storyline.queries.ranking import FULL_CHAIN, ranked
from storyline.session import scratch_path
from storyline.sources.tables import export_full_and_subset


def ranked_articles(spark, sf_dir):
    """Ranked representatives with every article column."""
    ranks = ranked(spark, sf_dir).select("id", "topic", "duplicate_count", "rrf_rank")
    return articles(spark, sf_dir).join(ranks, ["id", "topic"])


def _shown(df):
    return df.select(
        "source", "author", "headline", F.md5("summary").alias("summary_md5"), "keywords", "rrf_rank",
        "sentiment", F.date_format("publishedAt", "yyyy-MM-dd HH:mm:ss").alias("published"),
        "duplicate_count", "url", "topic",
    )


def ui_projection(spark, sf_dir):
    rows = rank.ui_projection(ranked_articles(spark, sf_dir))
    return _shown(rows).orderBy("topic", "rrf_rank", "url")


def export_ui_and_full(spark, sf_dir):
    """Rows of both exports after reading them back."""
    path = scratch_path(spark, "export")
    rows = rank.ui_projection(ranked_articles(spark, sf_dir))
    export_full_and_subset(rows, f"{path}/full", f"{path}/ui", C.UI_RANK_CUT)
    full = _shown(spark.read.parquet(f"{path}/full")).withColumn("export", F.lit("full"))
    page = _shown(spark.read.parquet(f"{path}/ui")).withColumn("export", F.lit("ui"))
    return full.unionByName(page)


def highlights_head5(spark, sf_dir):
    rows = highlights.head_per_topic(rank.top_with_ties(ranked_articles(spark, sf_dir)))
    return rows.select(F.col("id").alias("doc_id"), "topic", "rrf_rank")


def _for_page(spark, sf_dir):
    return rank.top_with_ties(ranked_articles(spark, sf_dir)).withColumn("source", F.col("source.name"))


def highlights_markdown(spark, sf_dir):
    return highlights.highlights_by_topic(_for_page(spark, sf_dir), as_of(PAGE_AS_OF_TEXT))


def highlights_page(spark, sf_dir):
    return highlights.highlights_page(_for_page(spark, sf_dir), as_of(PAGE_AS_OF_TEXT))


QUERIES = {
    "ui_projection": ui_projection,
    "export_ui_and_full": export_ui_and_full,
    "highlights_head5": highlights_head5,
    "highlights_markdown": highlights_markdown,
    "highlights_page": highlights_page,
}

_BASE = "WITH RECURSIVE " + ",".join(p.strip() for p in (*FULL_CHAIN, ARTICLES_SQL)) + """,
full_rows AS (
  SELECT a.*, r.duplicate_count, r.rrf_rank FROM art a JOIN ranked r ON r.id = a.id AND r.topic = a.topic)
"""

_COLUMNS = """source, author, headline, md5(summary) AS summary_md5, keywords, rrf_rank, sentiment,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, duplicate_count, url, topic"""

_PAGE = _BASE + f""",
head AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rrf_rank, id) AS rn FROM full_rows WHERE rrf_rank <= 15)
  WHERE rn <= 5),
lines AS (
  SELECT topic, rrf_rank, id,
    '### ' || headline
    || CASE WHEN epoch_us(TIMESTAMP '{PAGE_AS_OF_TEXT}') - epoch_us(published_at) < 86400000000 THEN ' 🆕' ELSE '' END
    || chr(10) || chr(10)
    || '*Source: **' || CASE WHEN coalesce(url, '') <> '' THEN '[' || source || '](' || url || ')' ELSE source END
    || '** | Published: ' || strftime(published_at, '%Y-%m-%d %H:%M') || '*' || chr(10) || chr(10)
    || '*Sentiment: ' || CASE sentiment WHEN 'positive' THEN '😀 Positive' WHEN 'negative' THEN '😟 Negative'
                                        ELSE '😐 Mixed view' END || '*' || chr(10) || chr(10)
    || CASE WHEN duplicate_count > 1 THEN '*Frequency: 🔄 This event has been reported ' || duplicate_count
            || ' times*' || chr(10) || chr(10) ELSE '' END
    || summary || chr(10) || chr(10)
    || CASE WHEN coalesce(keywords_shown, '') <> '' THEN '**Keywords:** ' || keywords_shown || chr(10) || chr(10) ELSE '' END
    || CASE WHEN coalesce(url, '') <> '' THEN '[Read Full Article](' || url || ')' || chr(10) || chr(10) ELSE '' END
    || '---' || chr(10) || chr(10) AS block
  FROM head),
pages AS (
  SELECT topic, '## 📌 ' || upper(topic) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
         || string_agg(block, '' ORDER BY rrf_rank, id) AS markdown
  FROM lines GROUP BY topic)
"""

SQL = {
    "ui_projection": _BASE + f"SELECT {_COLUMNS} FROM full_rows",
    "export_ui_and_full": _BASE + f"""
SELECT {_COLUMNS}, 'full' AS export FROM full_rows
UNION ALL SELECT {_COLUMNS}, 'ui' AS export FROM full_rows WHERE rrf_rank <= 15""",
    "highlights_head5": _PAGE + "SELECT id AS doc_id, topic, rrf_rank FROM head",
    "highlights_markdown": _PAGE + "SELECT topic, markdown FROM pages",
    "highlights_page": _PAGE + """
SELECT '# 📰 News Hub' || chr(10) || chr(10) || string_agg(markdown, '' ORDER BY topic) AS markdown FROM pages""",
}
