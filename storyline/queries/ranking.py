"""Near copies, representatives, relevance and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions import text as X
from storyline.operators import dedup, profile, rank, termjoin
from storyline.operators.skew import rank_in_group, top_n_per_group
from storyline.queries.base import LANGUAGES, articles, stage, table, texts
from storyline.session import scratch_path
from storyline.sources.tables import write_table

TOPIC_WORDS = 4
TOPIC_WORD_LENGTH = 5


def _term_sets(spark, sf_dir):
    return termjoin.term_sets(texts(spark, sf_dir), "doc_id", "text")


def edges(spark, sf_dir):
    sets = stage(spark, sf_dir, "term-sets", _term_sets, store=False)
    return stage(spark, sf_dir, "near-edges", lambda s, d: termjoin.neighbour_edges(sets))


def near_dup_edges(spark, sf_dir):
    return edges(spark, sf_dir)


def _counted(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return dedup.duplicate_count(nodes, edges(spark, sf_dir))


def duplicate_count(spark, sf_dir):
    return _counted(spark, sf_dir).select(F.col("id").alias("doc_id"), "duplicate_count")


def duplicate_count_histogram(spark, sf_dir):
    return profile.value_histogram(_counted(spark, sf_dir), "duplicate_count")


def _kept(spark, sf_dir):
    return dedup.keep_representatives(_counted(spark, sf_dir), edges(spark, sf_dir))


def kept(spark, sf_dir):
    return stage(spark, sf_dir, "kept", _kept)


def greedy_dedup(spark, sf_dir):
    return kept(spark, sf_dir).select(F.col("id").alias("doc_id"), "duplicate_count")


def derived_topics(spark, sf_dir):
    """(topic, text): the most widespread longer words of each language."""
    docs = texts(spark, sf_dir, "lang").select(
        F.col("lang").alias("topic"), F.explode_outer(F.array_distinct(X.words(F.col("text")))).alias("term")
    )
    counts = profile.group_counts(docs.where(F.length("term") >= TOPIC_WORD_LENGTH), "topic", "term")
    top = top_n_per_group(counts, ["topic"], [F.desc("n"), F.col("term")], TOPIC_WORDS)
    return top.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))


def _relevance(spark, sf_dir):
    topics = stage(spark, sf_dir, "topics", derived_topics)
    docs = texts(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return rank.topic_relevance(docs, rank.topic_words_of(topics), "id", "text")


def relevance(spark, sf_dir):
    return stage(spark, sf_dir, "relevance", _relevance)


def topic_relevance(spark, sf_dir):
    """Wide form: one importance column per topic."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    wide = rank.importance_columns(docs, relevance(spark, sf_dir), "id", LANGUAGES)
    return wide.select(
        F.col("id").alias("doc_id"),
        *[F.round(f"{t}_importance", 6).alias(f"{t}_importance") for t in LANGUAGES],
    )


def _members(spark, sf_dir):
    """Representatives with their own topic and relevance to it."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"))
    members = kept(spark, sf_dir).join(langs, "id")
    return rank.with_importance(members, relevance(spark, sf_dir), "id")


def members(spark, sf_dir):
    return stage(spark, sf_dir, "members", _members)


def importance_rank(spark, sf_dir):
    ranked = rank_in_group(members(spark, sf_dir), "topic", "importance", "importance_rank")
    return ranked.select(F.col("id").alias("doc_id"), "topic", "importance_rank")


def frequency_rank(spark, sf_dir):
    ranked = rank_in_group(members(spark, sf_dir), "topic", "duplicate_count", "feq_rank")
    return ranked.select(F.col("id").alias("doc_id"), "topic", "feq_rank")


def ranked(spark, sf_dir):
    return stage(spark, sf_dir, "ranked", lambda s, d: rank.fused_ranks(members(s, d)))


def rrf_score(spark, sf_dir):
    return ranked(spark, sf_dir).select(
        F.col("id").alias("doc_id"), "topic", F.round("rrf_score", 9).alias("rrf_score")
    )


def rrf_rank(spark, sf_dir):
    return rank.fused_ranks(members(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "topic", "importance_rank", "feq_rank", "rrf_rank"
    )


def topic_union(spark, sf_dir):
    """The ranked frames of all topics united again."""
    path = scratch_path(spark, "by-topic")
    write_table(ranked(spark, sf_dir).select(F.col("id").alias("doc_id"), "topic", "rrf_rank"), path, "overwrite", ["topic"])
    # one folder per topic: the scan of all of them is the union, whatever the number of topics
    return spark.read.schema("doc_id long, topic string, rrf_rank long").parquet(path)


def top15_with_ties(spark, sf_dir):
    return rank.top_with_ties(ranked(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "topic", "duplicate_count", "rrf_rank"
    )


def topic_partitioned_write(spark, sf_dir):
    """One folder per topic, read back as one table."""
    rows = ranked(spark, sf_dir).select(F.col("id").alias("doc_id"), "topic", "rrf_rank")
    path = scratch_path(spark, "topics")
    write_table(rows, path, "overwrite", ["topic"])
    return spark.read.schema(rows.schema).parquet(path)


def story_ranking(spark, sf_dir):
    """From raw documents to the top stories of each topic."""
    titles = articles(spark, sf_dir).select("id", "headline")
    top = rank.top_with_ties(ranked(spark, sf_dir)).select(
        "id", "topic", "duplicate_count", "importance_rank", "feq_rank", "rrf_rank"
    )
    return top.join(titles, "id").withColumnRenamed("id", "doc_id")


QUERIES = {
    "near_dup_edges": near_dup_edges,
    "duplicate_count": duplicate_count,
    "duplicate_count_histogram": duplicate_count_histogram,
    "greedy_dedup": greedy_dedup,
    "topic_relevance": topic_relevance,
    "importance_rank": importance_rank,
    "frequency_rank": frequency_rank,
    "rrf_score": rrf_score,
    "rrf_rank": rrf_rank,
    "topic_union": topic_union,
    "top15_with_ties": top15_with_ties,
    "topic_partitioned_write": topic_partitioned_write,
    "story_ranking": story_ranking,
}

EDGES_SQL = r"""
w AS (
  SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS term FROM documents),
sizes AS (SELECT id, count(*) AS n FROM w GROUP BY id),
shared AS (
  SELECT a.id AS src, b.id AS dst, count(*) AS overlap
  FROM w a JOIN w b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id),
near AS (
  SELECT src, dst, overlap, x.n AS n_src, y.n AS n_dst,
         row_number() OVER (PARTITION BY src ORDER BY overlap::DOUBLE * overlap / y.n DESC, dst) AS pos
  FROM shared JOIN sizes x ON x.id = src JOIN sizes y ON y.id = dst
  WHERE 10000 * overlap * overlap >= 8100 * x.n * y.n),
edge AS (SELECT src, dst, pos, overlap, n_src, n_dst FROM near WHERE pos <= 4),
counted AS (
  SELECT d.doc_id AS id, d.lang AS topic, 1 + count(e.src) AS duplicate_count
  FROM documents d LEFT JOIN edge e ON e.src = d.doc_id GROUP BY d.doc_id, d.lang)"""

KEPT_SQL = """
marks AS (
  SELECT d.doc_id AS id, row_number() OVER (ORDER BY d.doc_id) AS rn, coalesce(o.marked, []) AS marked
  FROM documents d LEFT JOIN (
    SELECT src, list(dst) AS marked FROM edge WHERE src < dst GROUP BY src) o ON o.src = d.doc_id),
walk(rn, visited) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT m.rn, CASE WHEN list_contains(walk.visited, m.id) THEN walk.visited
                    ELSE list_concat(walk.visited, m.marked) END
  FROM walk JOIN marks m ON m.rn = walk.rn + 1),
gone AS (SELECT unnest(visited) AS id FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
kept AS (SELECT * FROM counted WHERE id NOT IN (SELECT id FROM gone))"""

RELEVANCE_SQL = r"""
tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
norms AS (SELECT id, sum(tf * tf) AS norm2 FROM tf GROUP BY id),
spread AS (
  SELECT d.lang AS topic, tf.term, count(*) AS n FROM tf JOIN documents d ON d.doc_id = tf.id
  WHERE length(tf.term) >= 5 GROUP BY d.lang, tf.term),
topic_terms AS (
  SELECT topic, term FROM (
    SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rn FROM spread)
  WHERE rn <= 4),
topic_norms AS (SELECT topic, count(*) AS norm2 FROM topic_terms GROUP BY topic),
scores AS (
  SELECT tf.id, t.topic, sum(tf.tf)::DOUBLE / sqrt((n.norm2 * tn.norm2)::DOUBLE) AS importance
  FROM tf JOIN topic_terms t USING (term) JOIN norms n ON n.id = tf.id JOIN topic_norms tn ON tn.topic = t.topic
  GROUP BY tf.id, t.topic, n.norm2, tn.norm2)"""

RANKED_SQL = """
fused AS (
  SELECT k.id, k.topic, k.duplicate_count,
         rank() OVER (PARTITION BY k.topic ORDER BY coalesce(s.importance, 0) DESC) AS importance_rank,
         rank() OVER (PARTITION BY k.topic ORDER BY k.duplicate_count DESC) AS feq_rank
  FROM kept k LEFT JOIN scores s ON s.id = k.id AND s.topic = k.topic),
scored AS (
  SELECT *, 1::DOUBLE / (60 + importance_rank) + 1::DOUBLE / (60 + feq_rank) AS rrf_score FROM fused),
ranked AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY rrf_score DESC) AS rrf_rank FROM scored)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"


FULL_CHAIN = (EDGES_SQL, KEPT_SQL, RELEVANCE_SQL, RANKED_SQL)
_EDGES = _with(EDGES_SQL)
_KEPT = _with(EDGES_SQL, KEPT_SQL)
_RANKED = _with(*FULL_CHAIN)

SQL = {
    "near_dup_edges": _EDGES + "SELECT src, dst, pos, overlap, n_src, n_dst FROM edge",
    "duplicate_count": _EDGES + "SELECT id AS doc_id, duplicate_count FROM counted",
    "duplicate_count_histogram": _EDGES
    + "SELECT duplicate_count, count(*) AS n FROM counted GROUP BY duplicate_count",
    "greedy_dedup": _KEPT + "SELECT id AS doc_id, duplicate_count FROM kept",
    "topic_relevance": _with(RELEVANCE_SQL) + "SELECT d.doc_id, "
    + ", ".join(
        f"round(coalesce(max(s.importance) FILTER (s.topic = '{t}'), 0), 6) AS {t}_importance" for t in LANGUAGES
    )
    + " FROM documents d LEFT JOIN scores s ON s.id = d.doc_id GROUP BY d.doc_id",
    "importance_rank": _RANKED + "SELECT id AS doc_id, topic, importance_rank FROM ranked",
    "frequency_rank": _RANKED + "SELECT id AS doc_id, topic, feq_rank FROM ranked",
    "rrf_score": _RANKED + "SELECT id AS doc_id, topic, round(rrf_score, 9) AS rrf_score FROM ranked",
    "rrf_rank": _RANKED + "SELECT id AS doc_id, topic, importance_rank, feq_rank, rrf_rank FROM ranked",
    "topic_union": _RANKED + "SELECT id AS doc_id, topic, rrf_rank FROM ranked",
    "top15_with_ties": _RANKED
    + "SELECT id AS doc_id, topic, duplicate_count, rrf_rank FROM ranked WHERE rrf_rank <= 15",
    "topic_partitioned_write": _RANKED + "SELECT id AS doc_id, topic, rrf_rank FROM ranked",
    "story_ranking": _RANKED + """
SELECT id AS doc_id, ranked.topic, duplicate_count, importance_rank, feq_rank, rrf_rank,
       split_part(d.text, chr(10), 1) AS headline
FROM ranked JOIN documents d ON d.doc_id = ranked.id WHERE rrf_rank <= 15""",
}
