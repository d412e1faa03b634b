import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.operators import callback, chat, highlights, profile, rank
from storyline.plans import stages
from storyline.sources import tables
from storyline.sources.tables import export_full_and_subset


def test_relevance_of_the_topic_words(spark):
    texts = [
        (0, "The athlete won the tournament, a record score"),
        (1, "The market and the economy: an investment story"),
        (2, "Nothing to see"),
        (3, ""),
    ]
    df = spark.createDataFrame(texts, "id bigint, text string")
    words = rank.topic_words(C.TOPIC_KEYWORDS, spark)
    got = {(r["id"], r["topic"]): r["importance"] for r in rank.topic_relevance(df, words, "id", "text").collect()}
    assert set(got) == {(0, "sports"), (1, "finance")}
    # words: the 2, six others once; topic: five words
    assert got[(0, "sports")] == pytest.approx(3 / (10 * 5) ** 0.5)
    wide = rank.importance_columns(df, rank.topic_relevance(df, words, "id", "text"), "id", C.TOPICS)
    row = wide.where("id = 2").first()
    assert [row[f"{t}_importance"] for t in C.TOPICS] == [0, 0, 0, 0]


def test_article_in_two_topics_appears_twice(spark):
    df = spark.createDataFrame([(1, ["music", "art", "sports"])], "id int, categories array<string>")
    got = rank.articles_by_topic(df, "categories", C.TOPICS)
    assert sorted(r["topic"] for r in got.collect()) == ["music", "sports"]


def test_fused_ranks_are_within_the_topic(spark):
    rows = [(1, "a", 0.9, 1), (2, "a", 0.5, 3), (3, "a", 0.5, 1), (4, "b", 0.1, 5)]
    df = spark.createDataFrame(rows, "id int, topic string, importance double, duplicate_count int")
    ranked = rank.fused_ranks(df).collect()
    got = {r["id"]: (r["importance_rank"], r["feq_rank"], r["rrf_rank"]) for r in ranked}
    assert got == {1: (1, 2, 1), 2: (2, 1, 1), 3: (2, 2, 3), 4: (1, 1, 1)}


def test_ties_at_the_cut_stay_but_head_is_exact(spark):
    df = spark.createDataFrame([(i, "a", min(i, 15)) for i in range(1, 21)], "id int, topic string, rrf_rank int")
    assert rank.top_with_ties(df).count() == 20
    tied = spark.createDataFrame([(i, "a", 1) for i in range(9)], "id int, topic string, rrf_rank int")
    assert sorted(r["id"] for r in highlights.head_per_topic(tied).collect()) == [0, 1, 2, 3, 4]


AS_OF = dt.datetime(2024, 1, 3)


def page_rows(spark):
    new, old = AS_OF - dt.timedelta(seconds=86_399), AS_OF - dt.timedelta(seconds=86_400)
    data = [
        (1, "music", 1, "src", "Head", "Sum", '["a", "b"]', "positive", new, 2, "http://u"),
        (2, "music", 2, "src", "Two", "S2", "odd words", "MIXED view", old, 1, ""),
        (3, "arts", 1, None, "Three", None, None, None, old, 1, None),
    ]
    return spark.createDataFrame(
        data,
        "id int, topic string, rrf_rank int, source string, headline string, summary string, keywords string, "
        "sentiment string, publishedAt timestamp, duplicate_count int, url string",
    )


def test_highlights_text(spark):
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    page = highlights.highlights_page(page_rows(spark), as_of).first()["markdown"]
    assert page == (
        "# 📰 News Hub\n\n"
        "## 📌 ARTS\n\n---\n\n"
        "### Three\n\n*Source: **None** | Published: 2024-01-02 00:00*\n\n*Sentiment: 😐 *\n\nNone\n\n---\n\n"
        "## 📌 MUSIC\n\n---\n\n"
        "### Head 🆕\n\n*Source: **[src](http://u)** | Published: 2024-01-02 00:00*\n\n"
        "*Sentiment: 😀 Positive*\n\n*Frequency: 🔄 This event has been reported 2 times*\n\n"
        "Sum\n\n**Keywords:** `a`, `b`\n\n[Read Full Article](http://u)\n\n---\n\n"
        "### Two\n\n*Source: **src** | Published: 2024-01-02 00:00*\n\n*Sentiment: 😐 Mixed view*\n\n"
        "S2\n\n**Keywords:** odd words\n\n---\n\n"
    )


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, i) for i in range(1, 31)], "id int, rrf_rank int")
    full, page = str(tmp_path / "full"), str(tmp_path / "page")
    for _ in range(2):
        export_full_and_subset(df, full, page, C.UI_RANK_CUT)
    assert spark.read.parquet(full).count() == 30
    assert spark.read.parquet(page).count() == 15


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "t string, v int")
    assert [tuple(r) for r in profile.duplicate_keys(df, "t", "v").collect()] == [("a", 1, 2)]
    assert [tuple(r) for r in profile.value_histogram(df, "v").collect()] == [(1, 2), (2, 1)]


def make_client():
    return {"live": 0, "peak": 0}


async def counting_model(client, text):
    import asyncio

    client["live"] += 1
    client["peak"] = max(client["peak"], client["live"])
    await asyncio.sleep(0.001)
    client["live"] -= 1
    if text == "bad":
        raise ValueError("no")
    return f"{text}:{client['peak']}"


def test_calls_are_bounded_and_failures_are_nulls(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(40)], "id bigint, text string")
    got = {r["id"]: r["reply"] for r in callback.call_model(df, "id", "text", make_client, counting_model, max_concurrency=4, partitions=2).collect()}
    assert len(got) == 40 and got[3] is None
    peaks = {int(v.split(":")[1]) for v in got.values() if v}
    assert max(peaks) == 4


class LoopBound:
    """A client whose lock belongs to the loop it was made in."""

    def __init__(self):
        import asyncio

        self.gate, self.loop, self.closed = asyncio.Semaphore(2), asyncio.get_running_loop(), False

    async def aclose(self):
        assert not self.closed
        self.closed = True


async def loop_bound_model(client, text):
    import asyncio

    async with client.gate:
        await asyncio.sleep(0)
        if asyncio.get_running_loop() is not client.loop:
            raise RuntimeError("another loop")
        if text == "bad":
            raise ValueError("no")
        return text


def test_a_client_keeps_its_loop_over_all_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, "bad" if i % 10 == 3 else f"t{i}") for i in range(60)], "id bigint, text string")
        got = callback.call_model(df, "id", "text", LoopBound, loop_bound_model, partitions=2, error="error").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["id"], r["reply"], r["error"]) for r in got} == {
        (i, None, "ValueError: no") if i % 10 == 3 else (i, f"t{i}", None) for i in range(60)
    }


async def title_vector(client, title):
    return [float(len(title)), 1.0]


def test_titles_that_cannot_be_embedded_stay_null(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id bigint, title string")
    got = callback.embed_titles(df, "id", "title", make_client, title_vector)
    assert {r["id"]: r["title_embedding"] for r in got.collect()} == {1: [3.0, 1.0], 2: None, 3: None}


async def article_model(client, prompt):
    title = prompt.split("\n")[0].removeprefix("Title: ")
    if title == "Broken":
        return "sorry"
    return '```json\n{"categories": ["music"], "summary": "about %s", "headline": "%s!"}```' % (title, title)


def test_stages_from_articles_to_export(spark, tmp_path):
    data = [
        (0, "u0", "Band plays concert", "A concert, an album", None, ("1", "s0")),
        (1, "u1", "Band plays concert", "A concert, an album", None, ("2", "s1")),
        (2, "u2", "Broken", "d", "c", (None, "s2")),
    ]
    schema = "id bigint, url string, title string, description string, content string, source struct<id:string,name:string>"
    articles = spark.createDataFrame(data, schema).withColumns(
        {"author": F.lit("x"), "publishedAt": F.current_timestamp()}
    )
    rich = stages.enrich(articles, make_client, article_model)
    assert rich.where("success").count() == 2
    kept = stages.deduplicate_by_words(rich, "title", F.lit(9))
    words = rank.topic_words(C.TOPIC_KEYWORDS, spark)
    ranked = stages.rank_topics(kept, words, C.TOPICS, F.lit(9))
    rows = ranked.collect()
    assert [(r["topic"], r["duplicate_count"], r["rrf_rank"]) for r in rows] == [("music", 2, 1)]
    assert rows[0]["music_importance"] > 0 and rows[0]["finance_importance"] == 0
    stages.export(ranked, str(tmp_path / "full"), str(tmp_path / "ui"))
    out = spark.read.parquet(str(tmp_path / "ui")).first()
    assert out["source"] == "s0" and out["headline"] == "Band plays concert!"


def fetch(query, language, from_date, page, page_size):
    topic = query.split()[1]
    if topic == "finance":
        raise RuntimeError("quota")
    return [
        {
            "title": f"{topic} {i % 2}", "description": "concert", "content": from_date, "url": f"{topic}/{i}",
            "publishedAt": f"2024-01-0{i + 1}T00:00:00Z", "source": {"id": None, "name": f"s{i}"},
        }
        for i in range(4)
    ]


async def topic_model(client, prompt):
    topic, number = prompt.split("\n")[0].removeprefix("Title: ").split()
    return '{"categories": ["%s"], "summary": "a concert", "headline": "%s no %s", "sentiment": "neutral"}' % (
        topic, topic, number,
    )


async def number_vector(client, title):
    topic, number = title.split()
    return [1.0 if t == topic else 0.0 for t in C.TOPICS] + [2.0 * int(number)]


def test_every_stage_from_feed_to_prompt(spark, tmp_path):
    as_of = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    news, errors = stages.acquire(spark, fetch, as_of, "m", "v")
    assert [tuple(r) for r in errors.collect()] == [("finance", "page 1: quota")]
    tables.write_batch(news, str(tmp_path / "news"))
    latest = tables.read_latest(spark, str(tmp_path / "news"))
    assert latest.count() == 12 and latest.first()["content"] == "2023-12-27"
    articles = stages.clean(latest, F.lit(2))
    rich = stages.embed(stages.enrich(articles, make_client, topic_model), make_client, number_vector)
    kept = stages.deduplicate_by_vectors(rich, "title_embedding", F.lit(3))
    # odd numbers are near each other over all topics, even ones only within theirs
    evens = kept.where("headline like '%no 0'").collect()
    assert sorted((r["headline"], r["duplicate_count"]) for r in evens) == [
        ("lifestyle no 0", 2), ("music no 0", 2), ("sports no 0", 2),
    ]
    words = rank.topic_words(C.TOPIC_KEYWORDS, spark)
    ranked = stages.rank_topics(kept, words, C.TOPICS, F.lit(4))
    full, page, index = (str(tmp_path / n) for n in ("full", "ui", "index-v1"))
    stages.export(ranked, full, page)
    facts = stages.index_export(spark, full, index).first()
    assert facts["num_docs"] == ranked.count() and facts["collection"] == "index-v1"
    asked = spark.createDataFrame(
        [(1, "a concert", True, "music")], "question_id bigint, question string, intention boolean, category string"
    )
    prompt = stages.answer_prompts(asked, index, F.lit("sys")).where("part = 3").first()["content"]
    assert '"topic": "music"' in prompt and '"topic": "sports"' not in prompt


def test_chat_rows(spark):
    log = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 5, "user", "d")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    counts = {(r["conv_id"], r["turn"]): r["interaction_count"] for r in chat.interaction_count(log).collect()}
    assert counts == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (2, 5): 1}
    history = chat.chat_history(log).orderBy("conv_id", "position").collect()
    assert [(r["position"], r["content"]) for r in history] == [(1, "a"), (2, "b"), (3, "c"), (1, "d")]
