"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline import constants as C

WORD_PATTERN = r"(\p{L}+)"


def words(text: Column) -> Column:
    """Letter runs of the lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def word_set(text: Column) -> Column:
    """Distinct letter runs in sorted order: equal sets give equal arrays."""
    return F.sort_array(F.array_distinct(words(text)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """Everything behind the first line break; empty when there is none."""
    return F.when(
        F.contains(text, F.lit("\n")), F.substr(text, F.locate("\n", text) + 1)
    ).otherwise(F.lit(""))


def feed_query(topic: Column) -> Column:
    return F.concat_ws(" ", F.lit(C.QUERY_PREFIX), topic)


def printed(value: Column) -> Column:
    """A missing value is printed as ``None`` in prompts and documents."""
    return F.coalesce(value, F.lit("None"))


def article_text(title: Column, description: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Title: "), printed(title),
        F.lit("\n\nDescription: "), printed(description),
        F.lit("\n\nContent: "), printed(content),
    )


def combined_text(headline: Column, summary: Column) -> Column:
    """Headline and summary; null when either is missing."""
    return F.concat(headline, F.lit("\n\n"), summary)


def document_text(headline: Column, summary: Column) -> Column:
    return combined_text(printed(headline), printed(summary))


def parse_categories(text: Column) -> Column:
    """All categories of the JSON list text."""
    return F.from_json(text, "array<string>")


def parse_categories_untrimmed(text: Column) -> Column:
    """Brackets and quotes dropped, cut at commas, blanks kept: of a list written
    with ``", "`` only the first element ever equals a topic."""
    return F.split(F.translate(text, '["]', ""), ",")


def all_terms_present(terms: Column, *fields: Column) -> Column:
    """Every term occurs as a word of some field."""
    tokens = words(F.concat_ws(" ", *fields))
    return F.forall(terms, lambda term: F.array_contains(tokens, F.lower(term)))


def capitalize(text: Column) -> Column:
    """First letter up, all others down."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def sentiment_mark(sentiment: Column) -> Column:
    marks = F.when(F.lit(False), F.lit(""))
    for value, mark in C.SENTIMENT_MARKS.items():
        marks = marks.when(sentiment == value, F.lit(mark))
    return marks.otherwise(F.lit(C.OTHER_SENTIMENT_MARK))


def list_text(items: Column) -> Column:
    """JSON text of a list of strings, elements parted by comma and blank; null stays null."""
    quoted = F.transform(
        items, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", ", "null"), F.lit("]"))


def render_keywords(text: Column) -> Column:
    """List text as back-quoted words; unreadable text stays as it is."""
    items = F.from_json(text, "array<string>")
    quoted = F.transform(
        items, lambda k: F.concat(F.lit("`"), F.btrim(k, F.lit('"')), F.lit("`"))
    )
    return F.coalesce(F.array_join(quoted, ", "), text)


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""
