"""Models behind a result store, and the repairs around export, topics and the feed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.operators import answers, highlights, rank, textindex
from storyline.plans import stages
from storyline.sources import feed


def make_client():
    return None


def counting(path):
    """A model that notes every call in a file; ``bad`` texts fail."""

    async def call(client, text):
        with open(path, "a") as file:
            file.write(text.replace("\n", " ") + "\n")
        if text.startswith("bad"):
            raise RuntimeError("no")
        return f"about {text}"

    return call


def vector_model(path):
    async def call(client, text):
        with open(path, "a") as file:
            file.write("v\n")
        return [float(text.count(c)) for c in "abcde"]

    return call


def calls(path):
    return len(open(path).readlines()) if os.path.exists(path) else 0


def test_each_text_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")
    model = answers.Model("m", "1", make_client, counting(log), str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "bad"), (6, "")], "id int, t string")
    got = {r["id"]: r["a"] for r in answers.with_answers(df, "t", model, "a").collect()}
    assert got == {1: "about x", 2: "about y", 3: "about x", 4: None, 5: None, 6: "about "}
    assert calls(log) == 4
    more = df.unionByName(spark.createDataFrame([(7, "z")], "id int, t string")).withColumn("a", F.lit("old"))
    again = {r["id"]: r["a"] for r in answers.with_answers(more, "t", model, "a").collect()}
    assert again == got | {7: "about z"}
    assert calls(log) == 6  # the new text, and the one that failed
    other = answers.Model("m", "2", make_client, counting(log), str(tmp_path / "store"))
    answers.with_answers(df, "t", other, "a").collect()
    assert calls(log) == 10  # another version has answers of its own


def test_hooks_of_index_and_prompts_ask_once(spark, tmp_path):
    rows = [(i, "s", "h%d" % i, "abc " * (i + 1) + "e", "[]", 1 + i, "positive", 1, "u%d" % i, "music") for i in range(4)]
    schema = "id long, source string, headline string, summary string, keywords string, rrf_rank long, sentiment string, duplicate_count long, url string, topic string"
    full = str(tmp_path / "full")
    spark.createDataFrame(rows, schema).withColumn("publishedAt", F.lit("2024-01-01").cast("timestamp")).write.parquet(full)
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    title = answers.Model("title", "1", make_client, counting(log), store)
    vector = answers.Model("vector", "1", make_client, vector_model(log), store, "array<float>")

    async def intent(client, text):
        with open(log, "a") as file:
            file.write("i\n")
        return '{"intention": %s, "category": "music"}' % ("false" if "code" in text else "true")

    intents = answers.Model("intent", "1", make_client, intent, store)
    worded = answers.Model("worded", "1", make_client, counting(log), store)
    asked = spark.createDataFrame([(1, "abc abc e"), (2, "write code"), (3, "Music ")], "question_id bigint, question string")
    seen = []
    for run in range(2):
        index = str(tmp_path / f"index-{run}")
        stages.index_export(spark, full, index, titles=title, vectors=vector)
        chunks = textindex.read_chunks(spark, index)
        assert {r["title"].split("\n")[0] for r in chunks.collect()} == {f"about h{i}" for i in range(4)}
        assert {len(r["dense"]) for r in chunks.collect()} == {5}
        options = dict(k=2, intents=intents, rephrasing=worded, vectors=vector)
        got = stages.answer_prompts(asked, index, F.lit("sys"), **options).orderBy("question_id", "part", "position").collect()
        assert {r["question_id"] for r in got} == {1, 3}
        texts = [r["content"] for r in got if r["part"] == 2]
        assert texts == ["abc abc e", "about abc abc e", "Music ", C.CANNED_QUESTIONS["music"]]
        assert all('"source": "s"' in r["content"] for r in got if r["part"] == 3)
        seen.append(calls(log))
    assert seen[1] == seen[0] == 4 + 4 + 3 + 1 + 2  # titles, chunks, intents, one rephrasing, questions


def test_ties_get_the_same_numbers_and_highlights_read_the_export(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "sports", i % 2, f"headline {rng.random()}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, topic string, rrf_rank long, headline string").selectExpr(
        "id", "named_struct('id', '', 'name', 's') AS source", "'a' AS author", "headline", "'x' AS summary", "'[]' AS keywords", "rrf_rank",
        "'positive' AS sentiment", "timestamp '2024-01-01' AS publishedAt", "1L AS duplicate_count", "CAST(NULL AS STRING) AS url", "topic",
    )
    numbers = []
    for run in range(2):
        full, page, index = (str(tmp_path / f"{run}-{n}") for n in ("full", "ui", "index"))
        stages.export(df.orderBy(F.rand(run)).repartition(3 + run), full, page)
        stages.index_export(spark, full, index)
        numbers.append({(r["id"], r["text"]) for r in textindex.read_chunks(spark, index).collect()})
        text = highlights.highlights_page(spark.read.parquet(page), F.lit("2024-01-03").cast("timestamp")).first()
        assert str(text).count("###") == C.HIGHLIGHTS_PER_TOPIC
    assert numbers[0] == numbers[1] and len(numbers[0]) == 30


def test_ten_thousand_topics(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(900)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for i in range(40)] + [(90, None), (91, "a a b")]
    topics = [(f"t{n}", " ".join(rng.choices(vocabulary, k=3))) for n in range(10_000)] + [("same", "a a b c")]
    words = rank.topic_words_of(spark.createDataFrame(topics, "topic string, text string"))
    df = spark.createDataFrame(texts, "id int, text string")
    whole = {(r["id"], r["topic"]): r["importance"] for r in rank.topic_relevance(df, words, "id", "text").collect()}
    split = {(r["id"], r["topic"]): r["importance"] for r in rank.topic_relevance(df, words, "id", "text", 9000).collect()}
    assert whole == split

    def cosine(a, b):
        a, b = a.split(), b.split()
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        return dot / (sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b))) ** 0.5 if dot else None

    want = {(i, t): c for i, text in texts if text for t, body in topics if set(text.split()) & set(body.split()) and (c := cosine(text, body))}
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k]) for k in want)
    plan = rank.topic_relevance(df, words, "id", "text")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_vectors_of_many_topics_travel_in_blocks(spark):
    rng = random.Random(3)
    topics = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(4)]) for n in range(50)], "topic int, topic_vector array<double>")
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)], "id int, vec array<double>")
    rows = lambda most: {(r["id"], r["topic"]): r["importance"] for r in rank.vector_relevance_rows(df, "id", "vec", topics, most).collect()}
    assert rows(512) == rows(7) and len(rows(7)) == 450


def test_membership_in_a_table_of_topics(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, None)], "id int, categories array<string>")
    topics = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "topic string")
    got = sorted((r["id"], r["topic"]) for r in rank.articles_by_topic(df, "categories", topics).collect())
    assert got == [(1, "a"), (1, "b")]


def odd_pages(query, language, from_date, page, page_size):
    return {"sports": None, "music": {"title": "no list"}, "finance": [None]}.get(query.split()[1], [{"title": "ok"}])


def test_a_page_that_is_no_list_ends_its_topic_alone(spark):
    got = feed.read_feed(spark, odd_pages, max_pages=2, page_size=3).collect()
    assert sorted(r["topic"] for r in got if r["error"]) == ["finance", "music", "sports"]
    assert [(r["topic"], r["title"]) for r in got if not r["error"]] == [("lifestyle", "ok")]
