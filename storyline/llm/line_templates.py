"""Line dedup by a log-template tree, in DataFrame functions alone.

A line is parsed to a fixed depth: its token count, then its first ``LEAD`` tokens;
tokens with digits are variable and read ``<*>``. The tokens after them form
``FIELDS`` fields of about equal length. Lines of one leaf (count and leading
tokens) belong to one template if all fields agree but one, which is then variable
too; a line with fewer tokens behind the lead than there are fields must agree as a
whole. A template recurs if its lines stand in at least ``MIN_DOCS`` documents of
different text; then all its lines but the first one are dropped. So boilerplate is
kept once; what the variable fields of the dropped lines held is lost with them.

Leaves of too few lines are left out before templates are looked at; every step
before a shuffle is an aggregate or carries hashes only, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import unused
from storyline.session import materialize

LEAD = 3
FIELDS = 4
MIN_DOCS = 5
#: Lines of fewer tokens are left alone: nothing tells their recurrence from chance.
MIN_TOKENS = 3


def _tokens(line: Column) -> Column:
    """Tokens between blanks, with those that hold a digit made variable."""
    split = F.split(F.btrim(line, F.lit(" \t\r")), "[ \t\r]+")
    masked = F.transform(split, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(line.rlike("[0-9]"), masked).otherwise(split)


def _field(tokens: Column, n: Column, i: int) -> Column:
    """Hash of the i-th of the fields that the tokens behind the lead are cut into."""
    first = F.floor((n - LEAD) * i / FIELDS).cast("int")
    last = F.floor((n - LEAD) * (i + 1) / FIELDS).cast("int")
    return F.xxhash64(F.slice(tokens, LEAD + 1 + first, last - first))


def _template_keys(tokens: Column, n: Column) -> Column:
    """Keys of the templates that a line belongs to: one per field that may vary."""
    one_open = [F.xxhash64("leaf", F.lit(i), *[f"field{j}" for j in range(FIELDS) if j != i]) for i in range(FIELDS)]
    whole = F.array(F.xxhash64("leaf", F.lit(-1), tokens))
    return F.when(n - LEAD >= FIELDS, F.array(*one_open)).otherwise(whole)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, leaf, keys): every line of enough tokens, as hashes."""
    # parsed before they are exploded, so that no later step parses a line again
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.transform(F.split("text", "\n"), _tokens)).alias("line_no", "tokens"),
    )
    tokens, n = F.col("tokens"), F.size("tokens")
    fields = {f"field{i}": _field(tokens, n, i) for i in range(FIELDS)}
    leaf = F.xxhash64(n, F.slice(tokens, 1, LEAD))
    parsed = lines.where(n >= MIN_TOKENS).withColumns({"leaf": leaf, **fields})
    return parsed.select("doc_id", "text_hash", "line_no", "leaf", _template_keys(tokens, n).alias("keys"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, dropped array<int>): numbers of the lines to drop."""
    lines = materialize(parsed_lines(docs), "parsed-lines")
    # stored, so that both sides of the joins are plain shuffles, which can be split at a hot key
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs)
    leaves = materialize(leaves.select("leaf"), "crowded-leaves")
    crowded = lines.join(leaves, "leaf", "left_semi")
    keyed = materialize(
        crowded.select("doc_id", "text_hash", "line_no", F.explode("keys").alias("key")), "template-keys"
    )
    place = F.struct("doc_id", "text_hash", "line_no")
    per_text = keyed.groupBy("key", "text_hash").agg(F.min(place).alias("first"))
    recurring = (
        per_text.groupBy("key")
        .agg(F.count("*").alias("texts"), F.min("first").alias("first"))
        .where(F.col("texts") >= min_docs)
    )
    recurring = materialize(recurring.select("key", "first"), "recurring-templates")
    later = keyed.join(recurring, "key").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("dropped"))


def drop_recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, out: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with ``text`` without its recurring lines, and n_lines, n_dropped.

    The columns of ``docs`` stay, whatever their names; the new columns, named by
    ``out``, replace columns of that name. A null text stays null and has no lines; an empty
    text has one empty line. Lines without tokens stay. Repeated rows are treated
    alike. The first line of a template is that of the smallest doc_id (null first).
    """
    key, text_hash, dropped = (unused([*docs.columns, *out], name) for name in ("_id", "_hash", "_dropped"))
    found = recurring_lines(docs.select("doc_id", "text"), min_docs).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("dropped").alias(dropped)
    )
    joined = docs.join(
        found, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left"
    )
    split = F.split("text", "\n")
    kept = F.filter(split, lambda _, i: ~F.array_contains(dropped, i.cast("int")))
    counted = joined.withColumn(out[0], F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"))
    counted = counted.withColumn(out[1], F.when(F.col(text_hash).isNull(), F.lit(0)).otherwise(F.size(dropped)).cast("long"))
    text = F.when(F.col(out[1]) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return counted.withColumn("text", text).drop(key, text_hash, dropped)


SQL = rf"""
WITH line AS (
  SELECT doc_id, md5(text) AS text_hash, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), token AS (
  SELECT doc_id, text_hash, line_no,
         list_transform(regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13)), '[ \t\r]+'),
                        lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM line WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), parsed AS (
  SELECT *, len(tokens) AS n, len(tokens) || '|' || array_to_string(tokens[1:{LEAD}], ' ') AS leaf
  FROM token WHERE len(tokens) >= {MIN_TOKENS}
), fielded AS (
  SELECT *, {', '.join(f"array_to_string(tokens[{LEAD} + 1 + (n - {LEAD}) * {i} // {FIELDS} : {LEAD} + (n - {LEAD}) * {i + 1} // {FIELDS}], ' ') AS f{i}" for i in range(FIELDS))}
  FROM parsed WHERE leaf IN (SELECT leaf FROM parsed GROUP BY leaf HAVING count(*) >= {MIN_DOCS})
), keyed AS (
  {' UNION ALL '.join(f"SELECT doc_id, text_hash, line_no, leaf || '|{i}|' || {' || chr(10) || '.join(f'f{j}' for j in range(FIELDS) if j != i)} AS key FROM fielded WHERE n - {LEAD} >= {FIELDS}" for i in range(FIELDS))}
  UNION ALL SELECT doc_id, text_hash, line_no, leaf || '|-1|' || array_to_string(tokens, ' ') FROM fielded WHERE n - {LEAD} < {FIELDS}
), recurring AS (
  SELECT key, min({{'doc_id': doc_id, 'line_no': line_no}}) AS first
  FROM keyed GROUP BY key HAVING count(DISTINCT text_hash) >= {MIN_DOCS}
), dropped AS (
  SELECT DISTINCT doc_id, line_no FROM keyed JOIN recurring USING (key)
  WHERE first <> {{'doc_id': doc_id, 'line_no': line_no}}
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE d.line_no IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text
  FROM line l LEFT JOIN dropped d USING (doc_id, line_no) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, kept.text AS kept_text
FROM documents LEFT JOIN kept USING (doc_id)
"""
