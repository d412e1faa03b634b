"""Model replies, callbacks and vectors."""

from __future__ import annotations

import asyncio

from pyspark.sql import functions as F

from storyline.functions import replies, vectors
from storyline.functions import text as X
from storyline.operators import callback, densejoin, profile, rank
from storyline.operators.skew import first_per_key
from storyline.queries.base import ARTICLES_SQL, articles, stage, table, with_sql


def _replies(spark, sf_dir):
    """One raw reply per article; by id plain, fenced, broken, a list, with missing
    keys, with a text in place of a list, or with explicit nulls."""
    rows = articles(spark, sf_dir)
    full = F.to_json(
        F.struct(
            F.array("topic").alias("categories"), "summary",
            F.array(F.col("topic"), F.col("source.name")).alias("keywords"),
            F.array(F.col("source.name")).alias("key_entities"), "sentiment", "headline",
        )
    )
    partial = F.to_json(F.struct("summary", F.array("topic").alias("categories")))
    nulls = F.concat(F.lit('{"categories": null, "headline": null, "summary": '), F.to_json(F.struct("summary")), F.lit("}"))
    scalar = F.to_json(F.struct(F.col("topic").alias("categories"), F.col("source.name").alias("keywords")))
    kind = F.col("id") % 7
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("```")))
        .when(kind == 2, F.concat(F.lit("Sorry: "), full))
        .when(kind == 3, F.concat(F.lit("["), full, F.lit("]")))
        .when(kind == 4, partial)
        .when(kind == 5, scalar)
        .otherwise(nulls)
    )
    return rows.select("id", reply.alias("reply"))


def model_reply_parse(spark, sf_dir):
    parsed = replies.parse_reply(_replies(spark, sf_dir))
    return parsed.select(
        F.col("id").alias("doc_id"),
        F.array_join("categories", "|").alias("categories"),
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("key_entities", "|").alias("key_entities"),
        F.md5("summary").alias("summary_md5"), "sentiment", "headline", "success",
    )


def enrich_success_rate(spark, sf_dir):
    return profile.success_rate(replies.parse_reply(_replies(spark, sf_dir)))


def enrich_merge(spark, sf_dir):
    """Label rows as keyed results beside their articles; missing ones stay null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    results = table(spark, sf_dir, "labels")
    return callback.merge_results(docs, results, "doc_id").select("doc_id", "source", "quality", "toxic")


def embedding_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return callback.merge_results(docs, found, "doc_id").select(
        "doc_id", "lang", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")
    )


class _Client:
    """Bound to the loop of its first call, as clients with pools or locks are."""

    def __init__(self):
        self.gate = asyncio.Semaphore(2)
        self.name = "reply"


def _make_client():
    return _Client()


async def _word_model(client, text):
    """Stands for a remote model: fails on texts with a digit, else counts."""
    async with client.gate:
        await asyncio.sleep(0)
        if any(c in "0123456789" for c in text):
            raise ValueError("refused")
        return f"{client.name}: {len(text)}"


def batch_model_callback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return callback.call_model(docs, "doc_id", "text", _make_client, _word_model, error="error")


def sentiment_badge(spark, sf_dir):
    rows = articles(spark, sf_dir)
    badge = F.concat(X.sentiment_mark(F.col("sentiment")), F.lit(" "), X.capitalize(F.col("sentiment")))
    return rows.select(F.col("id").alias("doc_id"), badge.alias("badge"))


def keywords_render(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), X.render_keywords(F.col("keywords")).alias("keywords"))


def l2_normalize(spark, sf_dir):
    unit = vectors.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(unit).alias("dim", "x")
    ).select("vec_id", "dim", F.round("x", 6).alias("x"))


def embedding_json_roundtrip(spark, sf_dir):
    text = vectors.to_json_text(F.col("embedding"))
    back = vectors.from_json_text(text)
    total = F.aggregate(back, F.lit(0.0), lambda acc, x: acc + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(back).alias("dims"), F.round(total, 4).alias("total")
    )


def _neighbours(spark, sf_dir):
    rows = densejoin.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return densejoin.nearest_neighbours(rows, 4)


def knn_self_join(spark, sf_dir):
    near = stage(spark, sf_dir, "vector-neighbours", _neighbours)
    return near.select("src", "dst", "pos", F.round("sim", 6).alias("sim"))


VECTOR_THRESHOLD = 0.35


def vector_near_edges(spark, sf_dir):
    near = stage(spark, sf_dir, "vector-neighbours", _neighbours)
    return densejoin.threshold_edges(near, VECTOR_THRESHOLD).select("src", "dst", "pos")


def topic_vector_relevance(spark, sf_dir):
    """Cosine of every vector with one topic vector per label, its first one."""
    rows = table(spark, sf_dir, "embeddings")
    topics = first_per_key(rows, ["label"], ["vec_id"]).select(
        F.col("label").alias("topic"), F.col("embedding").alias("topic_vector")
    )
    found = rank.vector_relevance_rows(rows, "vec_id", "embedding", topics)
    return found.select("vec_id", F.col("topic").alias("label"), F.round("importance", 6).alias("importance"))


QUERIES = {
    "model_reply_parse": model_reply_parse,
    "enrich_success_rate": enrich_success_rate,
    "enrich_merge": enrich_merge,
    "embedding_merge": embedding_merge,
    "batch_model_callback": batch_model_callback,
    "sentiment_badge": sentiment_badge,
    "keywords_render": keywords_render,
    "l2_normalize": l2_normalize,
    "embedding_json_roundtrip": embedding_json_roundtrip,
    "knn_self_join": knn_self_join,
    "vector_near_edges": vector_near_edges,
    "topic_vector_relevance": topic_vector_relevance,
}

_REPLIES = with_sql(ARTICLES_SQL) + r""", raw AS (
  SELECT id, id % 7 AS kind, json_object('categories', topic, 'keywords', source)::VARCHAR AS scalar,
         json_object('categories', [topic], 'summary', summary, 'keywords', [topic, source],
                     'key_entities', [source], 'sentiment', sentiment, 'headline', headline)::VARCHAR AS whole,
         json_object('summary', summary, 'categories', [topic])::VARCHAR AS part,
         '{"categories": null, "headline": null, "summary": ' || json_object('summary', summary)::VARCHAR || '}' AS nulls
  FROM art),
rep AS (
  SELECT id, CASE kind WHEN 0 THEN whole WHEN 1 THEN '```json' || chr(10) || whole || '```'
         WHEN 2 THEN 'Sorry: ' || whole WHEN 3 THEN '[' || whole || ']' WHEN 4 THEN part WHEN 5 THEN scalar ELSE nulls END AS reply
  FROM raw),
body AS (
  SELECT id, regexp_replace(regexp_replace(reply, '^[`json]+', ''), '`+$', '') AS body FROM rep),
obj AS (
  SELECT id, try_cast(body AS JSON) AS j,
         coalesce(json_valid(body) AND json_type(try_cast(body AS JSON)) = 'OBJECT', false) AS success FROM body),
parsed AS (
  SELECT id, success, CASE WHEN success THEN json_keys(j) ELSE [] END AS keys, j FROM obj)
"""


def _list(name: str) -> str:
    return (
        f"CASE WHEN NOT list_contains(keys, '{name}') THEN '' "
        f"WHEN json_type(j->'$.{name}') = 'VARCHAR' THEN j->>'$.{name}' "
        f"ELSE array_to_string(CAST(j->'$.{name}' AS VARCHAR[]), '|') END"
    )


def _text(name: str) -> str:
    return f"CASE WHEN NOT list_contains(keys, '{name}') THEN '' ELSE j->>'$.{name}' END"


SQL = {
    "model_reply_parse": _REPLIES + f"""
SELECT id AS doc_id, {_list("categories")} AS categories, {_list("keywords")} AS keywords,
       {_list("key_entities")} AS key_entities, md5({_text("summary")}) AS summary_md5,
       {_text("sentiment")} AS sentiment, {_text("headline")} AS headline, success
FROM parsed""",
    "enrich_success_rate": _REPLIES + """
SELECT count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM parsed""",
    "enrich_merge": "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "embedding_merge": """
SELECT d.doc_id, d.lang, len(e.embedding) AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "batch_model_callback": """
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'reply: ' || length(text) END AS reply,
       CASE WHEN regexp_matches(text, '[0-9]') THEN 'ValueError: refused' END AS error FROM documents""",
    "sentiment_badge": """
SELECT d.doc_id, CASE l.quality WHEN 1 THEN '😀 Positive' WHEN 0 THEN '😟 Negative' ELSE '😐 Mixed view' END AS badge
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "keywords_render": with_sql(ARTICLES_SQL) + "SELECT id AS doc_id, keywords_shown AS keywords FROM art",
    "l2_normalize": """
SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, round(unnest(list_transform(embedding::DOUBLE[],
       lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS x
FROM embeddings""",
    "embedding_json_roundtrip": """
SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""",
}

_KNN = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding::DOUBLE[],
         lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vec FROM embeddings),
pairs AS (
  SELECT a.id AS src, b.id AS dst, list_inner_product(a.vec, b.vec) AS sim FROM v a JOIN v b ON a.id <> b.id),
near AS (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS pos, sim FROM pairs)
"""
SQL["knn_self_join"] = _KNN + "SELECT src, dst, pos, round(sim, 6) AS sim FROM near WHERE pos <= 4"
SQL["vector_near_edges"] = _KNN + f"SELECT src, dst, pos FROM near WHERE pos <= 4 AND sim >= {VECTOR_THRESHOLD}"

SQL["topic_vector_relevance"] = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[],
         lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vec FROM embeddings),
t AS (SELECT label, arg_min(vec, vec_id) AS vec FROM v GROUP BY label)
SELECT v.vec_id, t.label, round(list_inner_product(v.vec, t.vec), 6) AS importance FROM v CROSS JOIN t"""
