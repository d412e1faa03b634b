"""Per-topic highlight text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions import text as X
from storyline.functions.times import is_new, minute_text
from storyline.operators.skew import top_n_per_group


def head_per_topic(df: DataFrame, n: int = C.HIGHLIGHTS_PER_TOPIC, tie: str = "id") -> DataFrame:
    """First ``n`` rows per topic in rank order."""
    return top_n_per_group(df, ["topic"], [F.col("rrf_rank"), F.col(tie)], n)


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def article_block(as_of: Column) -> Column:
    """Markdown of one article row."""
    c = F.col
    sentiment = F.coalesce(c("sentiment"), F.lit(""))
    headline = _line(
        "### ", X.printed(c("headline")),
        F.when(is_new(c("publishedAt"), as_of), F.lit(C.NEW_MARK)).otherwise(F.lit("")), "\n\n",
    )
    source = X.printed(c("source"))
    name = F.when(X.present(c("url")), _line("[", source, "](", c("url"), ")")).otherwise(source)
    origin = _line("*Source: **", name, "** | Published: ", F.coalesce(minute_text(c("publishedAt")), F.lit("")), "*\n\n")
    mood = _line("*Sentiment: ", X.sentiment_mark(sentiment), " ", X.capitalize(sentiment), "*\n\n")
    frequency = F.when(
        c("duplicate_count") > 1,
        _line("*Frequency: 🔄 This event has been reported ", c("duplicate_count").cast("string"), " times*\n\n"),
    ).otherwise(F.lit(""))
    summary = _line(X.printed(c("summary")), "\n\n")
    rendered = X.render_keywords(c("keywords"))
    keywords = F.when(X.present(rendered), _line("**Keywords:** ", rendered, "\n\n")).otherwise(F.lit(""))
    more = F.when(X.present(c("url")), _line("[Read Full Article](", c("url"), ")\n\n")).otherwise(F.lit(""))
    return _line(headline, origin, mood, frequency, summary, keywords, more, C.RULE)


def highlights_by_topic(df: DataFrame, as_of: Column, tie: str = "id") -> DataFrame:
    """One text per topic: its heading and the blocks of its first rows in rank order."""
    blocks = head_per_topic(df, tie=tie).withColumn("block", article_block(as_of))
    # at most HIGHLIGHTS_PER_TOPIC blocks per topic
    joined = blocks.groupBy("topic").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rrf_rank", tie, "block"))), lambda b: b["block"]
            ),
            "",
        ).alias("body")
    )
    heading = _line("## 📌 ", F.upper("topic"), "\n\n", C.RULE)
    return joined.select("topic", F.concat(heading, "body").alias("markdown"))


def highlights_page(df: DataFrame, as_of: Column, tie: str = "id") -> DataFrame:
    """The whole page as one row: title, then the topics in sorted order."""
    per_topic = highlights_by_topic(df, as_of, tie)
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("topic", "markdown"))), lambda t: t["markdown"]), ""
    )
    return per_topic.agg(_line(C.HIGHLIGHTS_TITLE, body).alias("markdown"))
