import datetime as dt

from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions import replies
from storyline.functions import text as X
from storyline.functions import times, vectors
from storyline.operators import retrieve


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def parsed(spark, reply):
    df = spark.createDataFrame([(reply,)], "reply string")
    return replies.parse_reply(df).first().asDict()


GOOD = '{"categories": ["sports", "finance"], "summary": "s", "keywords": ["k"], "key_entities": [], "sentiment": "positive", "headline": "h"}'


def test_plain_and_fenced_replies(spark):
    for reply in (GOOD, "```json\n" + GOOD + "```"):
        row = parsed(spark, reply)
        assert row["success"] is True
        assert row["categories"] == ["sports", "finance"]
        assert (row["summary"], row["sentiment"], row["headline"]) == ("s", "positive", "h")
        assert row["keywords"] == ["k"] and row["key_entities"] == []


def test_failed_replies_give_the_failure_record(spark):
    for reply in ("no object", "[1, 2]", "null", "7", '"text"', "", None):
        row = parsed(spark, reply)
        assert row["success"] is False, reply
        assert row["categories"] == [] and row["keywords"] == [] and row["key_entities"] == []
        assert (row["summary"], row["sentiment"], row["headline"]) == ("", "", "")


def test_missing_key_has_default_but_null_stays_null(spark):
    row = parsed(spark, '{"summary": null, "categories": null}')
    assert row["success"] is True
    assert row["summary"] is None and row["categories"] is None
    assert row["headline"] == "" and row["keywords"] == []


def test_a_text_in_place_of_a_list_is_a_list_of_one(spark):
    got = parsed(spark, '{"categories": "sports", "keywords": ["a", "b"], "key_entities": null}')
    assert (got["categories"], got["keywords"], got["key_entities"]) == (["sports"], ["a", "b"], None)


def test_intents(spark):
    cases = {
        '{"intention": true, "category": "music"}': (True, "music"),
        '{"intention": true}': (True, "general"),
        '```json\n{"intention": true, "category": "sports"}```': (True, "sports"),
        '{"category": "sports"}': (False, "general"),
        "broken {": (False, "general"),
        "[true]": (False, "general"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    got = {r["reply"]: (r["intention"], r["category"]) for r in replies.parse_intent(df).collect()}
    assert got == cases


def test_only_first_category_matches_without_trim(spark):
    text = '["sports", "finance"]'
    assert one(spark, X.parse_categories_untrimmed(F.lit(text))) == ["sports", " finance"]
    assert one(spark, X.parse_categories(F.lit(text))) == ["sports", "finance"]
    assert one(spark, X.parse_categories_untrimmed(F.lit("[]"))) == [""]
    assert one(spark, X.parse_categories(F.lit("[]"))) == []
    assert one(spark, X.parse_categories(F.lit(None).cast("string"))) is None


def test_keywords(spark):
    assert one(spark, X.render_keywords(F.lit('["a", "b c"]'))) == "`a`, `b c`"
    assert one(spark, X.render_keywords(F.lit("['a', 'b']"))) == "`a`, `b`"
    assert one(spark, X.render_keywords(F.lit("plain words"))) == "plain words"
    assert one(spark, X.render_keywords(F.lit("[]"))) == ""
    assert one(spark, X.render_keywords(F.lit(None).cast("string"))) is None


def test_list_text(spark):
    items = F.array(F.lit('a "q"'), F.lit("[b]"), F.lit(None))
    assert one(spark, X.list_text(items)) == '["a \\"q\\"", "[b]", null]'
    assert one(spark, X.list_text(F.array().cast("array<string>"))) == "[]"
    assert one(spark, X.list_text(F.lit(None).cast("array<string>"))) is None
    assert one(spark, X.parse_categories(X.list_text(items))) == ['a "q"', "[b]", None]


def test_capitalize_lowers_the_rest(spark):
    assert one(spark, X.capitalize(F.lit("MIXED view"))) == "Mixed view"
    assert one(spark, X.sentiment_mark(F.lit("positive"))) == "😀"
    assert one(spark, X.sentiment_mark(F.lit("MIXED view"))) == "😐"


def test_missing_parts_of_texts(spark):
    none = F.lit(None).cast("string")
    assert one(spark, X.article_text(F.lit("t"), none, F.lit("c"))) == (
        "Title: t\n\nDescription: None\n\nContent: c"
    )
    assert one(spark, X.combined_text(F.lit("h"), none)) is None
    assert one(spark, X.document_text(F.lit("h"), none)) == "h\n\nNone"


def test_feed_terms(spark):
    assert one(spark, X.feed_query(F.lit("music"))) == "Australian music"
    terms = F.array(F.lit("Australian"), F.lit("music"))
    assert one(spark, X.all_terms_present(terms, F.lit("New MUSIC"), F.lit("australian tour"))) is True
    assert one(spark, X.all_terms_present(terms, F.lit("musical"), F.lit("Australian"))) is False


def test_timestamps(spark):
    parse = lambda t: one(spark, times.parse_published(F.lit(t).cast("string")))
    assert parse("2024-05-01T10:00:00Z") == parse("2024-05-01 10:00:00")
    assert parse("2024-05-01T12:00:00+02:00") == parse("2024-05-01T10:00:00Z")
    for text in ("yesterday", "now", "10:30", "no time", "", None):
        assert parse(text) is None


def test_newness_is_strict(spark):
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    for age, expected in ((86_399, True), (86_400, False)):
        published = as_of - F.expr(f"INTERVAL {age} SECONDS")
        assert one(spark, times.is_new(published, as_of)) is expected


def test_dates(spark):
    as_of = F.lit("2024-01-31 15:00:00").cast("timestamp")
    assert one(spark, times.lower_date_bound(as_of)) == "2024-01-17"
    assert one(spark, times.batch_stamp(as_of)) == int(
        dt.datetime(2024, 1, 31, 15, tzinfo=dt.timezone.utc).timestamp()
    )
    assert one(spark, times.zone_text(as_of)) == "2024-01-31 15:00:00 +0000"


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.l2_normalize(v)) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [None, None]
    assert one(spark, vectors.from_json_text(vectors.to_json_text(v))) == [3.0, 4.0]


def test_fusion_starts_at_rank_one_and_falls(spark):
    score = lambda a, b: one(spark, vectors.reciprocal_rank_fusion([F.lit(a), F.lit(b)]))
    assert score(1, 1) == 2 / 61
    assert score(1, 1) > score(2, 1) > score(2, 2) > score(3, 2)


def test_rephrase(spark):
    assert one(spark, retrieve.rephrase(F.lit(" Music "))) == C.CANNED_QUESTIONS["music"]
    assert one(spark, retrieve.rephrase(F.lit("music awards"))) == "music awards"
