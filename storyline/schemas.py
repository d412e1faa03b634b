"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])

FEED_ARTICLE = T.StructType(
    [
        T.StructField("source", SOURCE),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("publishedAt", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

ARTICLE = T.StructType(
    FEED_ARTICLE.fields
    + [
        T.StructField("topic", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("batch_query_time", T.LongType()),
    ]
)

REPLY_LISTS = ["categories", "keywords", "key_entities"]
REPLY_TEXTS = ["summary", "sentiment", "headline"]

CHUNK_METADATA = [
    "source",
    "keywords",
    "duplicate_count",
    "rrf_rank",
    "sentiment",
    "topic",
    "publishedAt",
    "url",
]
