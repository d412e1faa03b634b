"""The article feed: a paged source per topic, the landed files, and its selections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storyline import constants as C
from storyline.functions.text import all_terms_present
from storyline.functions.times import lower_date_bound
from storyline.operators.skew import top_n_per_group
from storyline.schemas import FEED_ARTICLE

# fetch(query, language, from_date, page, page_size) -> list of article dicts
Fetch = Callable[[str, str, str, int, int], list[dict]]

FEED_ROW = T.StructType(
    FEED_ARTICLE.fields
    + [T.StructField("topic", T.StringType()), T.StructField("error", T.StringType())]
)
CORRUPT = "_corrupt_record"


class TopicPartition(InputPartition):
    def __init__(self, topic: str):
        self.topic = topic


class FeedReader(DataSourceReader):
    """Reads each topic in its own task, page by page."""

    def __init__(self, fetch: Fetch, options: dict):
        self.fetch = fetch
        self.topics = options.get("topics", ",".join(C.TOPICS)).split(",")
        self.language = options.get("language", C.FEED_LANGUAGE)
        self.from_date = options.get("from_date", "")
        self.max_pages = int(options.get("max_pages", C.MAX_PAGES))
        self.page_size = int(options.get("page_size", C.PAGE_SIZE))

    def partitions(self) -> list[InputPartition]:
        return [TopicPartition(topic) for topic in self.topics]

    def read(self, partition: TopicPartition) -> Iterator[tuple]:
        """A short or empty page ends the topic; a failing page ends it with an error row."""
        topic = partition.topic
        query = f"{C.QUERY_PREFIX} {topic}"
        for page in range(1, self.max_pages + 1):
            try:
                articles = self.fetch(query, self.language, self.from_date, page, self.page_size)
                rows = [self._values(article) for article in articles]
            except Exception as error:  # a failed call, or a page that is no list of articles
                yield (None,) * len(FEED_ARTICLE.fields) + (topic, f"page {page}: {error}")
                return
            for values in rows:
                yield (*values, topic, None)
            if len(rows) < self.page_size:
                return

    @staticmethod
    def _values(article: dict) -> list:
        source = article.get("source") or {}
        return [
            (source.get("id"), source.get("name")) if name == "source" else article.get(name)
            for name in FEED_ARTICLE.fieldNames()
        ]


def feed_source(fetch: Fetch, name: str = "article_feed") -> type[DataSource]:
    """A registrable data source over the caller's ``fetch`` function."""

    class ArticleFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return FEED_ROW

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return FeedReader(fetch, self.options)

    return ArticleFeed


def read_feed(spark: SparkSession, fetch: Fetch, **options) -> DataFrame:
    """All topics of the feed; rows with ``error`` tell which topic stopped early."""
    source = feed_source(fetch)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed article files; a line that cannot be read is kept in a side column."""
    schema = T.StructType(FEED_ARTICLE.fields + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def in_window(df: DataFrame, published: str, language: str, as_of: Column,
              wanted_language: str = C.FEED_LANGUAGE, days: int = C.FEED_WINDOW_DAYS) -> DataFrame:
    """Articles of the wanted language not older than the window (whole days)."""
    bound = F.to_date(lower_date_bound(as_of, days))
    return df.where((F.col(language) == wanted_language) & (F.col(published) >= bound))


def matching_terms(df: DataFrame, terms: list[str], *fields: str) -> DataFrame:
    wanted = F.array(*[F.lit(t) for t in terms])
    return df.where(all_terms_present(wanted, *[F.col(f) for f in fields]))


def newest_per_topic(df: DataFrame, topic: str, published: str, tie: str,
                     max_pages: int = C.MAX_PAGES, page_size: int = C.PAGE_SIZE) -> DataFrame:
    """The newest articles of each topic, as many as the pages hold."""
    order = [F.desc(published), F.col(tie)]
    return top_n_per_group(df, [topic], order, max_pages * page_size)
