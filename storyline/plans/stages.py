"""The news stages, each from DataFrame to DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions.replies import parse_intent, parse_reply
from storyline.functions.text import article_text, combined_text, first_line
from storyline.operators.answers import Model, with_answers
from storyline.operators import callback, dedup, densejoin, rank, retrieve, termjoin, textindex
from storyline.operators.chat import message_list
from storyline.operators.clean import clean_articles, stamp_batch
from storyline.operators.cells import read_cells
from storyline.operators.skew import dense_row_id, first_per_key
from storyline.schemas import ARTICLE
from storyline.session import materialize
from storyline.sources import feed
from storyline.sources.tables import export_full_and_subset

clean = clean_articles


def acquire(
    spark: SparkSession, fetch: feed.Fetch, as_of: datetime, model_name: str, model_version: str,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Stamped articles of one run, and the topics that stopped with an error.

    The feed is called once and stored, so both results come from the same pages.
    """
    from_date = (as_of - timedelta(days=C.FEED_WINDOW_DAYS)).strftime("%Y-%m-%d")
    fetched = materialize(feed.read_feed(spark, fetch, from_date=from_date, **options), "fetched")
    known = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    stamp = F.lit(int(known.timestamp()))
    articles = fetched.where(F.col("error").isNull()).drop("error")
    stamped = stamp_batch(articles, stamp, model_name, model_version).select(*ARTICLE.fieldNames())
    return stamped, fetched.where(F.col("error").isNotNull()).select("topic", "error")


def enrich(articles: DataFrame, make_client, model, **options) -> DataFrame:
    """Ask the model about every article and add the parsed reply columns."""
    prompts = articles.select(
        "id", article_text(F.col("title"), F.col("description"), F.col("content")).alias("prompt")
    )
    # stored, as every reading would ask (and pay) the model again
    replies = materialize(callback.call_model(prompts, "id", "prompt", make_client, model, **options), "replies")
    return callback.merge_results(articles, parse_reply(replies).drop("reply"), "id")


def embed(articles: DataFrame, make_client, model, **options) -> DataFrame:
    return callback.embed_titles(articles, "id", "title", make_client, model, **options)


def deduplicate(
    articles: DataFrame, edges: DataFrame, batch: Column, id_col: str = "id"
) -> DataFrame:
    """Representatives with their counts, restamped and renumbered in id order."""
    counted = dedup.duplicate_count(articles, edges, id_col)
    kept = dedup.keep_representatives(counted, edges, id_col)
    kept = kept.withColumn("batch_query_time", batch.cast("bigint"))
    return dense_row_id(kept.withColumnRenamed(id_col, "_old"), ["_old"], id_col).drop("_old")


def deduplicate_by_vectors(
    articles: DataFrame, vector: str, batch: Column, threshold: float = C.SIMILARITY_PERCENT / 100,
    k: int = C.NEIGHBOURS, normalize: bool = True,
) -> DataFrame:
    """First per url, then near copies by title vector; rows without a vector stay."""
    unique = materialize(first_per_key(articles, ["url"], ["id"]), "unique-urls")
    vectors = densejoin.unit_vectors(unique, "id", vector, normalize)
    near = densejoin.nearest_neighbours(vectors, k, unit=normalize, floor=threshold)
    near = materialize(near, "neighbours")
    return deduplicate(unique, densejoin.threshold_edges(near, threshold), batch)


def deduplicate_by_words(
    articles: DataFrame, text: str, batch: Column, k: int = C.NEIGHBOURS,
    percent: int = C.SIMILARITY_PERCENT,
) -> DataFrame:
    """First per url, then near copies by the word set of a text column."""
    unique = materialize(first_per_key(articles, ["url"], ["id"]), "unique-urls")
    sets = termjoin.term_sets(unique, "id", text)
    edges = materialize(termjoin.neighbour_edges(sets, k, percent), "edges")
    return deduplicate(unique, edges, batch)


def rank_topics(articles: DataFrame, topics: DataFrame, names: list[str], batch: Column) -> DataFrame:
    """One row per article and topic with importance, frequency and fused ranks."""
    text = combined_text(F.col("headline"), F.col("summary"))
    articles = materialize(articles.withColumn("combined_text", text), "to-rank")
    relevance = materialize(
        rank.topic_relevance(articles, topics, "id", "combined_text"), "relevance"
    )
    wide = rank.importance_columns(articles, relevance, "id", names)
    members = rank.articles_by_topic(wide, "categories", names)
    scored = rank.with_importance(members, relevance, "id")
    return rank.fused_ranks(materialize(scored, "scored")).withColumn(
        "batch_query_time", batch.cast("bigint")
    )


def export(ranked: DataFrame, full_path: str, ui_path: str) -> None:
    """Both exports; the id goes along, as highlights break ties by it."""
    carried = [c for c in ("id",) if c in ranked.columns]
    export_full_and_subset(rank.ui_projection(ranked, *carried), full_path, ui_path, C.UI_RANK_CUT)


def index_export(
    spark: SparkSession, full_path: str, index_path: str, titles: Model | None = None, vectors: Model | None = None, **options
) -> DataFrame:
    """Chunk and index the full export; returns the run facts.

    Rows are numbered by topic, rank and url, then by what else is in them, so ties get
    the same numbers at every run. ``titles`` makes a title of each document, ``vectors``
    the dense vector of each chunk; each text is asked about once, also over several runs.
    """
    stored = spark.read.parquet(full_path)
    rows = stored.withColumn("_row", F.xxhash64(*stored.columns)).drop("id")
    rows = dense_row_id(rows, ["topic", "rrf_rank", "url", "_row"]).drop("_row")
    docs = textindex.documents(rows).withColumn("topic", F.col("metadata.topic"))
    if titles:
        docs = materialize(with_answers(docs, "text", titles, "title"), "titled")
        docs = docs.withColumn("title", F.coalesce("title", first_line(F.col("text"))))
    return textindex.build_index(docs, index_path, vectors=vectors, **options)


def answer_prompts(
    questions: DataFrame, index_path: str, system: Column, history: DataFrame | None = None,
    k: int = C.TOP_K, intents: Model | None = None, rephrasing: Model | None = None, vectors: Model | None = None,
) -> DataFrame:
    """Message rows for every accepted question (question_id, question, intention, category).

    ``intents`` replies give intention and category where the questions do not bring them,
    ``rephrasing`` words a question anew (a bare topic word has its own question), and
    ``vectors`` must be the model of the index. Each text is asked about once. A question
    that could not be rephrased goes on as it is; one without a vector finds nothing.
    """
    spark = questions.sparkSession
    if intents:
        replied = materialize(with_answers(questions, "question", intents, "_reply"), "intents")
        questions = parse_intent(replied, "_reply").drop("_reply")
    asked = retrieve.in_scope(questions).withColumn("rephrased", retrieve.rephrase(F.col("question")))
    if rephrasing:
        # a bare topic word has its own question, and the model is not asked
        plain = asked.withColumn("_plain", F.when(F.col("rephrased") == F.col("question"), F.col("rephrased")))
        worded = materialize(with_answers(plain, "_plain", rephrasing, "_worded"), "rephrased")
        asked = worded.withColumn("rephrased", F.coalesce("_worded", "rephrased")).drop("_worded", "_plain")
    asked = textindex.vectorize(asked, "rephrased")
    if vectors:
        asked = textindex.model_vectors(asked, "rephrased", vectors)
    asked = materialize(asked, "questions")
    chunks = textindex.read_chunks(spark, index_path)
    hits = retrieve.dense_index_top_k(read_cells(spark, index_path), asked, k, category="category")
    context = retrieve.contexts(hits, chunks)
    prompts = asked.join(context, "question_id", "left").select(
        "question_id", "question", "rephrased",
        retrieve.user_prompt(F.col("rephrased"), F.coalesce("context", F.lit("[]"))).alias("prompt"),
    )
    return message_list(prompts, system, history)
