import json

import pytest
from pyspark.sql import functions as F

from storyline import session
from storyline.operators import clean
from storyline.schemas import ARTICLE
from storyline.sources import feed, tables
from storyline.streaming.ingest import ingest_landing


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def batch(spark, stamp, *names):
    return spark.createDataFrame([(n, stamp) for n in names], "name string, batch_query_time bigint")


def test_newest_batch_only(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(batch(spark, 1, "a", "b"), path)
    tables.write_batch(batch(spark, 2, "c").select("batch_query_time", "name"), path)
    assert rows(tables.read_latest(spark, path), "name") == [("c",)]
    assert tables.latest_batch_value(spark.read.parquet(path)).first()[0] == 2


def test_partition_pruning_of_the_newest_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(batch(spark, 1, "a").unionByName(batch(spark, 2, "b")), path)
    latest = tables.read_latest(spark, path)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters: [isnotnull(batch_query_time" in line]
    assert any("= 2)" in line for line in filters)
    assert rows(latest, "name") == [("b",)]


def test_empty_and_missing_tables(spark, tmp_path):
    empty = tables.read_latest(spark, str(tmp_path / "none"), ARTICLE)
    assert empty.count() == 0 and empty.columns == ARTICLE.fieldNames()
    assert tables.latest_batch_value(spark.createDataFrame([], ARTICLE)).count() == 0


def test_nothing_is_written_for_none(spark, tmp_path):
    tables.write_table(None, str(tmp_path / "none"))
    tables.save_as_table(None, "no_such_table")
    assert not (tmp_path / "none").exists()


def test_append_needs_the_same_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(2).withColumn("x", F.lit("a")), path)
    tables.write_table(spark.range(1).select(F.lit("b").alias("x"), "id"), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), path)


def test_overwrite_twice_is_the_same(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.write_table(spark.range(5), path, "overwrite")
    assert spark.read.parquet(path).count() == 5


def test_catalog_table(spark):
    spark.sql("DROP TABLE IF EXISTS stories_t")
    tables.save_as_table(spark.range(2).withColumn("x", F.lit(1)), "stories_t")
    tables.save_as_table(spark.range(3).select(F.lit(2).alias("x"), "id"), "stories_t")
    assert spark.table("stories_t").count() == 5
    tables.save_as_table(spark.range(1).withColumn("x", F.lit(1)), "stories_t", overwrite=True)
    assert spark.table("stories_t").count() == 1
    spark.sql("DROP TABLE stories_t")


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_batches(batch(spark, 1, "a"), path)
    for _ in range(2):
        tables.replace_batches(batch(spark, 2, "b", "c"), path)
    assert rows(spark.read.parquet(path), "name") == [("a",), ("b",), ("c",)]


def test_collection_path():
    assert tables.collection_path("/x/", "news", "v1") == "/x/news-v1"


def fetch(query, language, from_date, page, page_size):
    if query.endswith("finance"):
        raise RuntimeError("quota")
    if query.endswith("music"):
        return []
    size = {1: page_size, 2: 1}[page]
    return [{"title": f"{query} {page}.{i}", "source": {"name": language}, "content": from_date} for i in range(size)]


def test_paged_feed_isolates_errors(spark):
    got = feed.read_feed(spark, fetch, max_pages=5, page_size=3, from_date="2024-01-01")
    counts = {r["topic"]: r["n"] for r in got.where("error is null").groupBy("topic").agg(F.count("*").alias("n")).collect()}
    assert counts == {"sports": 4, "lifestyle": 4}
    errors = got.where("error is not null").collect()
    assert [(r["topic"], r["error"]) for r in errors] == [("finance", "page 1: quota")]
    first = got.where("topic = 'sports'").orderBy("title").first()
    assert first["source"]["name"] == "en" and first["content"] == "2024-01-01"


def test_page_cap(spark):
    got = feed.read_feed(spark, fetch, max_pages=1, page_size=3, topics="sports")
    assert got.count() == 3


def test_broken_landing_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "ok", "url": "u"}\n{"title": \n')
    got = feed.read_landing(spark, str(tmp_path)).cache()
    assert rows(got.where("_corrupt_record is null"), "title") == [("ok",)]
    assert got.where("_corrupt_record is not null").count() == 1


def test_newest_per_topic(spark):
    data = [(i, "t" if i % 2 else "u", i // 4) for i in range(20)]
    df = spark.createDataFrame(data, "id int, topic string, at int")
    got = feed.newest_per_topic(df, "topic", "at", "id", max_pages=1, page_size=3)
    want = []
    for topic in ("t", "u"):
        mine = sorted((d for d in data if d[1] == topic), key=lambda d: (-d[2], d[0]))
        want += mine[:3]
    assert rows(got, "id", "topic", "at") == sorted(want)


def test_union_of_unlike_frames_and_of_none(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y")], "id int, b string")
    got = clean.union_frames([a, b], a)
    assert rows(got, "id", "a", "b") == [(1, "x", None), (2, None, "y")]
    assert clean.union_frames([], a.limit(0)).columns == ["id", "a"]


def test_restamp_reads_the_old_value(spark):
    got = clean.restamp(batch(spark, 5, "a"), F.lit(9)).first()
    assert (got["step1_batch_query_time"], got["batch_query_time"]) == (5, 9)


def test_clean_articles(spark):
    data = [
        ("u1", "music", "2024-01-02T00:00:00Z"),
        ("u1", "music", "2024-01-01T00:00:00Z"),
        ("u1", "sports", "2024-01-03T00:00:00Z"),
        (None, "music", "2024-01-05T00:00:00Z"),
        (None, "music", "2024-01-04T00:00:00Z"),
    ]
    df = spark.createDataFrame(data, "url string, topic string, publishedAt string").withColumn(
        "batch_query_time", F.lit(1).cast("bigint")
    )
    got = clean.clean_articles(df, F.lit(2)).orderBy("id").collect()
    assert [(r["id"], r["url"], r["topic"], r["publishedAt"].day) for r in got] == [
        (0, "u1", "music", 1), (1, "u1", "sports", 3), (2, None, "music", 4),
    ]


def test_stream_ingest_appends_batches_once(spark, tmp_path):
    landing, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()

    def drop(name, *titles):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"title": t}) + "\n" for t in titles))

    def run():
        ingest_landing(spark, landing, table, check, "music", "m", "v", 100).awaitTermination()

    drop("a.json", "one", "two")
    run()
    drop("b.json", "three")
    run()
    run()
    got = spark.read.parquet(table)
    assert rows(got, "title", "batch_query_time") == [("one", 100), ("three", 101), ("two", 100)]
    assert rows(tables.read_latest(spark, table), "title", "query") == [("three", "Australian music")]


def test_stream_ingest_keeps_bad_lines_and_stamps(spark, tmp_path):
    landing, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"title": "one"}\n{broken\n')
    ingest_landing(spark, landing, table, check, "music", "m", "v", 100).awaitTermination()
    assert rows(spark.read.parquet(table), "title", "batch_query_time") == [("one", 100)]
    assert rows(spark.read.parquet(f"{table}-corrupt"), "_corrupt_record", "batch_query_time") == [("{broken", 100)]
    # the commit of the batch is lost, and the run that repeats it begins at another time
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    ingest_landing(spark, landing, table, check, "music", "m", "v", 999).awaitTermination()
    assert rows(spark.read.parquet(table), "title", "batch_query_time") == [("one", 100)]


def test_clean_articles_picks_the_same_of_tied_rows(spark):
    data = [("u", "t", "2024-01-01T00:00:00Z", title, 1) for title in "abcdefgh"] + [(None, "t", "2024-01-01T00:00:00Z", "z", 1)]
    frame = spark.createDataFrame(data, "url string, topic string, publishedAt string, title string, batch_query_time bigint")
    picks = {tuple(rows(clean.clean_articles(frame.repartition(n), F.lit(2)), "id", "title")) for n in (1, 3, 7)}
    assert len(picks) == 1


class Settings:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        return self.value or default


class Cluster:
    def __init__(self, value):
        self.conf = Settings(value)
        self.sparkContext = self
        self.master = "yarn"

    def getConf(self):
        return self.conf


def test_a_cluster_needs_a_shared_folder():
    assert session.checkpoint_root(Cluster("hdfs://shared/dir/")) == "hdfs://shared/dir"
    with pytest.raises(ValueError):
        session.checkpoint_root(Cluster(None))
