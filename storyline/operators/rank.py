"""Topic relevance and rank fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storyline import constants as C
from storyline.functions.text import list_text, words
from storyline.functions.vectors import inner_product, l2_normalize, reciprocal_rank_fusion
from storyline.operators.blocks import bounded_slices, entry_rows
from storyline.operators.skew import broadcast_if_small, rank_in_group
from storyline.session import materialize

#: Words of the topics, and vectors of them, that are sent to the tasks at a time.
MAX_TOPIC_WORDS = 100_000
MAX_TOPICS = 512


def topic_words(keywords: dict[str, list[str]], spark) -> DataFrame:
    """(topic, term, tf, topic_norm2) of the joined keyword text of each topic."""
    rows = [(topic, " ".join(phrases)) for topic, phrases in keywords.items()]
    return topic_words_of(spark.createDataFrame(rows, "topic string, text string"))


def topic_words_of(topics: DataFrame) -> DataFrame:
    """Word counts of each row of (topic, text) and the squared norm of its vector."""
    counted = (
        topics.select("topic", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("topic", "term")
        .agg(F.count(F.lit(1)).alias("topic_tf"))
    )
    norms = counted.groupBy("topic").agg(
        F.sum(F.col("topic_tf") * F.col("topic_tf")).alias("topic_norm2")
    )
    return counted.join(norms, "topic")


def topic_relevance(
    articles: DataFrame, topics: DataFrame, key: str, text: str, most_words: int = MAX_TOPIC_WORDS
) -> DataFrame:
    """Cosine of word counts for every (article, topic) pair that shares a word.

    ``topics`` is the output of :func:`topic_words_of`. Its words are counted; a block
    of topics with up to ``most_words`` of them goes to the tasks, and each article is
    multiplied with it where it lies, so nothing is shuffled by word. More topics are
    taken block by block. Pairs without a shared word have relevance 0 and are not
    listed: readers fill them in.
    """
    topics = materialize(topics, "topic-words")
    blocks = max(1, -(-topics.count() // most_words))
    tokens = articles.select(key, words(F.col(text)).alias("_tokens"))
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks))
    parts = [_block_relevance(tokens, key, topics.where(block == n)) for n in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _block_relevance(tokens: DataFrame, key: str, topics: DataFrame) -> DataFrame:
    """Relevance of every row of tokens to a block of topics, by a sparse product in each batch."""
    rows = topics.select("topic", "term", "topic_tf", "topic_norm2").collect()  # at most about MAX_TOPIC_WORDS
    names = sorted({r["topic"] for r in rows}, key=lambda t: (t is None, t))
    place = {name: n for n, name in enumerate(names)}
    norms = np.zeros(len(names), np.int64)
    listed: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        norms[place[r["topic"]]] = r["topic_norm2"]
        listed.setdefault(r["term"], []).append((place[r["topic"]], r["topic_tf"]))
    terms = pa.array(sorted(listed), pa.string())
    entries = [listed[t] for t in terms.to_pylist()]
    begin = np.concatenate(([0], np.cumsum([len(e) for e in entries]))).astype(np.int64)
    of_topic = np.array([t for e in entries for t, _ in e], np.int64)
    counts = np.array([n for e in entries for _, n in e], np.int64)
    topic_type = topics.schema["topic"].dataType
    schema = T.StructType([tokens.schema[key], T.StructField("topic", topic_type), T.StructField("importance", T.DoubleType())])

    def multiply(batches):
        shown = pa.array(names, to_arrow_type(topic_type))
        for batch in bounded_slices(batches, "_tokens"):
            lists = batch.column("_tokens")
            owner = entry_rows(lists)
            flat = lists.flatten().dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(len(flat.dictionary), 1)
            pairs, tf = np.unique(owner * width + codes, return_counts=True)
            norm2 = np.bincount(pairs // width, tf.astype(np.float64) ** 2, batch.num_rows).astype(np.int64)
            found = pc.fill_null(pc.index_in(flat.dictionary, value_set=terms), -1).to_numpy().astype(np.int64)
            known = found[codes] >= 0
            owner, word = owner[known], found[codes[known]]
            sizes = begin[word + 1] - begin[word]
            at = np.repeat(begin[word], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hits = np.repeat(owner, sizes) * max(len(names), 1) + of_topic[at]
            hit, inverse = np.unique(hits, return_inverse=True)
            dot = np.bincount(inverse, counts[at], len(hit))
            row, topic = hit // max(len(names), 1), hit % max(len(names), 1)
            importance = dot / np.sqrt((norm2[row] * norms[topic]).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row)), shown.take(pa.array(topic)), pa.array(importance)], [key, "topic", "importance"]
            )

    return tokens.select(key, "_tokens").where(F.size("_tokens") > 0).mapInArrow(multiply, schema)


def vector_relevance(
    articles: DataFrame, key: str, vector: str, topics: dict[str, list[float]]
) -> DataFrame:
    """One ``<topic>_importance`` column per topic: cosine of a model's vectors.

    The few topic vectors are literals, so this is a projection without a join.
    A vector without direction has no relevance (null).
    """
    unit = articles.select(key, l2_normalize(F.col(vector)).alias("_unit"))
    columns = []
    for topic, values in topics.items():
        length = sum(x * x for x in values) ** 0.5
        literal = F.array(*[F.lit(float(x) / length) for x in values])
        columns.append(inner_product(F.col("_unit"), literal).alias(f"{topic}_importance"))
    return unit.select(key, *columns)


def vector_relevance_rows(
    articles: DataFrame, key: str, vector: str, topics: DataFrame, most_topics: int = MAX_TOPICS
) -> DataFrame:
    """(key, topic, importance): cosine of a model's vectors with every topic of a table.

    ``topics`` is (topic, topic_vector), one row per topic. They are counted and travel in
    blocks of about ``most_topics`` as one value inside a scan, so articles are neither
    joined nor shuffled.
    """
    topics = materialize(topics.select("topic", l2_normalize(F.col("topic_vector")).alias("unit")), "topic-vectors")
    blocks = max(1, -(-topics.count() // most_topics))
    unit = articles.select(key, l2_normalize(F.col(vector)).alias("_unit"))
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks))
    parts = []
    for n in range(blocks):
        listed = topics.where(block == n).select(F.collect_list(F.struct("topic", "unit")).alias("listed"))
        parts.append(unit.withColumn("_topic", F.explode(listed.scalar())))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(key, "_topic.topic", inner_product(F.col("_unit"), F.col("_topic.unit")).alias("importance"))


def articles_by_topic(articles: DataFrame, categories: str, topics: list[str] | DataFrame) -> DataFrame:
    """One row per article and matching topic; an article may be in several.

    ``topics`` are a few names, or a table of any size with a column ``topic``.
    """
    if isinstance(topics, DataFrame):
        listed = articles.withColumn("topic", F.explode(F.array_distinct(F.col(categories))))
        wanted = broadcast_if_small(materialize(topics.select("topic").distinct(), "topics"))
        return listed.join(wanted, "topic", "left_semi").select(*articles.columns, "topic")
    wanted = F.array(*[F.lit(t) for t in topics])
    found = F.array_intersect(F.col(categories), wanted)
    return articles.withColumn("topic", F.explode(found))


def with_importance(members: DataFrame, relevance: DataFrame, key: str) -> DataFrame:
    """Relevance of each article to its own topic, 0 when no word is shared."""
    return members.join(relevance, [key, "topic"], "left").withColumn(
        "importance", F.coalesce("importance", F.lit(0.0))
    )


def importance_columns(articles: DataFrame, relevance: DataFrame, key: str, topics: list[str]) -> DataFrame:
    """One ``<topic>_importance`` column per topic, 0 when no word is shared."""
    wide = relevance.groupBy(key).agg(
        *[
            F.max(F.when(F.col("topic") == t, F.col("importance"))).alias(f"{t}_importance")
            for t in topics
        ]
    )
    joined = articles.join(wide, key, "left")
    return joined.fillna(0.0, subset=[f"{t}_importance" for t in topics])


def fused_ranks(df: DataFrame, k: int = C.RRF_CONSTANT) -> DataFrame:
    """Add importance, frequency and fused ranks within each topic.

    A rank reads its input twice, so the ranks before the last one are stored.
    """
    df = rank_in_group(df, "topic", "importance", "importance_rank")
    df = materialize(rank_in_group(df, "topic", "duplicate_count", "feq_rank"), "ranks")
    score = reciprocal_rank_fusion([F.col("importance_rank"), F.col("feq_rank")], k)
    return rank_in_group(df.withColumn("rrf_score", score), "topic", "rrf_score", "rrf_rank")


def top_with_ties(df: DataFrame, cut: int = C.UI_RANK_CUT) -> DataFrame:
    """Rows ranked up to ``cut``; ties at the cut all stay."""
    return df.where(F.col("rrf_rank") <= cut)


def ui_projection(df: DataFrame, *carried: str) -> DataFrame:
    """The export columns; ``source`` becomes the name held inside the struct.

    ``carried`` names columns that go along, such as the id that breaks ties.

    Keywords are exported as JSON list text, also when they come as a list.
    """
    keywords = F.col("keywords")
    if isinstance(df.schema["keywords"].dataType, T.ArrayType):
        keywords = list_text(keywords)
    return df.select(
        F.col("source.name").alias("source"),
        "author", "headline", "summary", keywords.alias("keywords"), "rrf_rank",
        "sentiment", "publishedAt", "duplicate_count", "url", "topic", *carried,
    )
