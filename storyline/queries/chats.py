"""Chat log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions import replies
from storyline.operators import chat, retrieve
from storyline.queries.base import table


def interaction_count(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chat.interaction_count(log)


def interaction_totals(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select("conv_id", "role")
    return log.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("interactions"))


def chat_history(spark, sf_dir):
    return chat.chat_history(table(spark, sf_dir, "conversations"))


def _intents(spark, sf_dir):
    """A raw intent reply per user turn; by number accepted, fenced, without category,
    broken, or without the decision."""
    kind = (F.col("conv_id") + F.col("turn")) % 7
    reply = (
        F.when(kind == 0, '{"intention": true, "reason": "news", "category": "music"}')
        .when(kind == 1, '```json\n{"intention": false, "category": "finance"}```')
        .when(kind == 2, '```json\n{"intention": true}```')
        .when(kind == 3, '{"intention": true, "category": ')
        .when(kind == 4, '{"category": "sports"}')
        .when(kind == 5, '[{"intention": true}]')
        .otherwise('{"category": "sports", "intention": true}')
    )
    log = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return replies.parse_intent(log.withColumn("reply", reply))


def intent_parse(spark, sf_dir):
    return _intents(spark, sf_dir).select("conv_id", "turn", "intention", "category")


def intent_gate(spark, sf_dir):
    accepted = retrieve.in_scope(_intents(spark, sf_dir))
    return accepted.select("conv_id", "turn", "category", F.col("text").alias("question"))


QUERIES = {
    "interaction_count": interaction_count,
    "interaction_totals": interaction_totals,
    "chat_history": chat_history,
    "intent_parse": intent_parse,
    "intent_gate": intent_gate,
}

_INTENTS = r"""
WITH raw AS (
  SELECT conv_id, turn, text, CASE (conv_id + turn) % 7
    WHEN 0 THEN '{"intention": true, "reason": "news", "category": "music"}'
    WHEN 1 THEN '```json' || chr(10) || '{"intention": false, "category": "finance"}```'
    WHEN 2 THEN '```json' || chr(10) || '{"intention": true}```'
    WHEN 3 THEN '{"intention": true, "category": '
    WHEN 4 THEN '{"category": "sports"}'
    WHEN 5 THEN '[{"intention": true}]'
    ELSE '{"category": "sports", "intention": true}' END AS reply
  FROM conversations WHERE role = 'user'),
body AS (
  SELECT *, CASE WHEN starts_with(reply, '```json')
    THEN regexp_replace(regexp_replace(reply, '^[`json]+', ''), '`+$', '') ELSE reply END AS b FROM raw),
obj AS (
  SELECT *, try_cast(b AS JSON) AS j, coalesce(json_valid(b) AND json_type(try_cast(b AS JSON)) = 'OBJECT'
    AND json_exists(try_cast(b AS JSON), '$.intention'), false) AS ok FROM body),
intents AS (
  SELECT conv_id, turn, text, ok AND (j->>'$.intention') = 'true' AS intention,
         CASE WHEN ok THEN coalesce(j->>'$.category', 'general') ELSE 'general' END AS category FROM obj)
"""

SQL = {
    "interaction_count": """
SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS interaction_count
FROM conversations""",
    "interaction_totals": """
SELECT conv_id, count(*) FILTER (role = 'user') AS interactions FROM conversations GROUP BY conv_id""",
    "chat_history": """
SELECT conv_id, rank() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role, text AS content FROM conversations""",
    "intent_parse": _INTENTS + "SELECT conv_id, turn, intention, category FROM intents",
    "intent_gate": _INTENTS + "SELECT conv_id, turn, category, text AS question FROM intents WHERE intention",
}
