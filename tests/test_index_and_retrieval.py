import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyline.operators import cells, postings, retrieve, skew, textindex
from storyline.plans import stages
from storyline.queries import base, texts
from storyline.session import BOUNDED_BATCHES, settings


def brute_pack(text, size, overlap):
    units, sentence = [], []
    words = re.findall(r"[^ \t\n\r\f]+[ \t\n\r\f]*", text)
    for n, word in enumerate(words):
        sentence.append(word)
        if n + 1 == len(words) or "\n" in word or word.rstrip(" \t\r\f")[-1] in ".!?":
            units += [sentence[i : i + size - overlap] for i in range(0, len(sentence), size - overlap)]
            sentence = []
    chunks, first, held = [], 0, 0
    for i, unit in enumerate(units):
        if held + len(unit) > size:
            chunks.append((first, i - 1))
            first, held = i, 0
            while first > chunks[-1][0] and held + len(units[first - 1]) <= overlap:
                first -= 1
                held += len(units[first])
        held += len(unit)
    if units:
        chunks.append((first, len(units) - 1))
    return ["".join(w for u in units[a : b + 1] for w in u).rstrip(" \t\n\r\f") for a, b in chunks]


def random_text(rng, n):
    parts = []
    for _ in range(n):
        parts.append(" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randrange(0, 9))))
        parts.append(rng.choice([". ", "! ", "\n", "... ", "? "]))
    return "".join(parts)


@pytest.mark.parametrize("size,overlap", [(12, 4), (5, 0), (20, 19)])
def test_sentence_chunks_equal_a_plain_walk(spark, size, overlap):
    rng = random.Random(size)
    texts = [random_text(rng, rng.randrange(0, 25)) for _ in range(40)] + ["", "...", "one", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {}
    for r in textindex.chunk_sentences(df, size, overlap).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["text"])
        assert r["n_words"] <= size
    want = {i: brute_pack(t, size, overlap) for i, t in enumerate(texts) if t}
    assert got == {i: c for i, c in want.items() if c}


def test_chunks_are_stretches_of_their_text(spark):
    rng = random.Random(4)
    pieces = ["Version 3.14", "of example.com", "costs U.S. $5.20!", "é", "\n\n", "  ", "\t", "What?", "a.b.c", "...", "x"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "  \n"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for chunks in (textindex.chunk_sentences(df, 12, 4), textindex.chunk_sliding(df, 12, 4)):
        words = Counter()
        for r in chunks.collect():
            assert r["text"] in texts[r["id"]] and len(r["text"].split()) == r["n_words"] <= 12
            words[r["id"]] += r["n_words"]
        assert all(words[i] >= len(t.split()) for i, t in enumerate(texts))
    plain = textindex.chunk_sentences(spark.createDataFrame([(1, "Version 3.14 of example.com costs U.S. $5.20")], "id bigint, text string"))
    assert plain.first()["text"] == "Version 3.14 of example.com costs U.S. $5.20"


def test_large_ids_and_number_like_topics_stay_apart(spark, tmp_path):
    rows = [(5, "2024", "one two"), (17592186044421, "2025", "one two"), (2**62, "2024", "three"), (-3, "007", "one")]
    textindex.build_index(spark.createDataFrame(rows, "id bigint, topic string, text string"), str(tmp_path / "i-v1"))
    chunks = textindex.read_chunks(spark, str(tmp_path / "i-v1"))
    assert chunks.select("chunk_id").distinct().count() == 4
    assert {r["topic"] for r in chunks.collect()} == {"2024", "2025", "007"}
    assert {r["title"] for r in chunks.collect()} == {"one two", "three", "one"}
    asked = textindex.vectorize(spark.createDataFrame([(1, "one two", "2025")], "question_id bigint, text string, category string"))
    found = retrieve.dense_top_k(chunks, asked, 3, "category").join(chunks, "chunk_id").collect()
    assert [r["id"] for r in found] == [17592186044421]


def test_sliding_windows_cover_every_word_once_more_than_the_overlap(spark):
    df = spark.createDataFrame([(n, " ".join(str(i) for i in range(n))) for n in range(0, 40)], "id bigint, text string")
    chunks = {}
    for r in textindex.chunk_sliding(df, 10, 3).orderBy("id", "chunk_no").collect():
        chunks.setdefault(r["id"], []).append(r["text"].split())
    assert 0 not in chunks
    for n, parts in chunks.items():
        assert [w for i, p in enumerate(parts) for w in (p if i == 0 else p[3:])] == [str(i) for i in range(n)]
        assert all(len(p) <= 10 for p in parts) and all(len(p) > 3 for p in parts[1:])


TOPIC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [x + y for x in "abcdefghij" for y in "klmno"]
    docs = [
        (i, TOPIC[i % 3], " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(120)
    ]
    docs += [(200 + i, "a", docs[7][2]) for i in range(5)]
    df = spark.createDataFrame(docs, "id bigint, topic string, text string").withColumn(
        "metadata",
        F.struct(
            F.lit("s").alias("source"), F.lit(None).cast("string").alias("keywords"), F.lit(2).alias("duplicate_count"),
            F.lit(1).alias("rrf_rank"), F.lit("positive").alias("sentiment"), F.col("topic"),
            F.lit("2024").alias("publishedAt"), F.lit(None).cast("string").alias("url"),
        ),
    )
    path = str(tmp_path_factory.mktemp("index") / "stories-v1")
    facts = textindex.build_index(df, path).first()
    assert (facts["num_docs"], facts["collection"]) == (125, "stories-v1")
    asked = [(i, " ".join(rng.choice(vocabulary) for _ in range(6)), ["general", "a", "b"][i % 3]) for i in range(30)]
    asked += [(90, docs[7][2], "general"), (91, "zzz", "general"), (92, "", "general")]
    questions = spark.createDataFrame(asked, "question_id bigint, text string, category string")
    return path, docs, asked, textindex.vectorize(questions)


def brute_hits(docs, asked, score, k, filtered):
    result, number = set(), {i: n for n, i in enumerate(sorted(d[0] for d in docs))}
    for q, text, category in asked:
        scored = []
        for i, topic, body in docs:
            if filtered and category not in ("general", topic):
                continue
            value = score(text, body)
            if value is not None:
                scored.append((-value, number[i]))
        result |= {(q, c, pos) for pos, (_, c) in enumerate(sorted(scored)[:k], 1)}
    return result


def hashed(text):
    counts = Counter()
    for w in text.split():
        counts[textindex.word_bucket(w, textindex.DENSE_DIMS)] += 1
    return counts


def dense_score(question, body):
    a, b = hashed(question), hashed(body)
    if not a:
        return None
    dot = sum(n * b[x] for x, n in a.items())
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5


def hits(df):
    return {(r["question_id"], r["chunk_id"], r["pos"]) for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [1000, 7])
@pytest.mark.parametrize("filtered", [False, True])
def test_dense_top_k_equals_brute_force(spark, index, slice_rows, filtered):
    path, docs, asked, questions = index
    chunks = textindex.read_chunks(spark, path).repartition(5)
    got = retrieve.dense_top_k(chunks, questions, 7, "category" if filtered else None, slice_rows)
    assert hits(got) == brute_hits(docs, asked, dense_score, 7, filtered)


@pytest.mark.parametrize("cell_rows,fan", [(4096, 16), (9, 4)])
@pytest.mark.parametrize("filtered", [False, True])
def test_search_of_the_cells_equals_brute_force(spark, index, tmp_path, cell_rows, fan, filtered):
    path, docs, asked, questions = index
    cells.write_cells(textindex.read_chunks(spark, path).repartition(3), str(tmp_path), cell_rows, fan)
    stored = cells.read_cells(spark, str(tmp_path))
    got = retrieve.dense_index_top_k(stored, questions, 7, "category" if filtered else None)
    assert hits(got) == brute_hits(docs, asked, dense_score, 7, filtered)


def test_the_search_skips_cells_and_topics(spark, tmp_path):
    """Vectors in clusters, two of three topics, a mass of copies and odd rows; cells read are counted."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 8
    vectors = [(centres[n % 40] + rng.normal(size=6)).astype("f4") for n in range(2400)] + [centres[3].astype("f4")] * 600
    topics = ["a", "b", None]
    rows = [(n, topics[n % 3], [float(x) for x in v], float((v.astype("f8") ** 2).sum())) for n, v in enumerate(vectors)]
    rows += [(9001, "a", [0.0] * 6, 0.0), (9002, "a", None, None)]
    schema = "chunk_id long, topic string, dense array<float>, norm2 double"
    chunks = spark.createDataFrame(rows, schema)
    cells.write_cells(chunks, str(tmp_path / "i"), 40, 8)
    stored = cells.read_cells(spark, str(tmp_path / "i"))
    assert stored.nodes.agg(F.max("level")).first()[0] >= 2
    asked = [(q, rows[7 * q][2], rows[7 * q][3], ["general", "a", "b", None, "nowhere"][q % 5]) for q in range(60)]
    asked += [(70, [0.0] * 6, 0.0, "general"), (71, None, None, "a")]
    questions = spark.createDataFrame(asked, "question_id long, dense array<float>, norm2 double, category string")
    for category in (None, "category"):
        found, visits = cells.search(questions, stored, 5, category)
        assert hits(retrieve._ranked([found], 5)) == hits(retrieve.dense_top_k(chunks, questions, 5, category))
        assert visits.distinct().count() == visits.count()
    # with the category: a topic question reads no cell of another topic, whatever the others ask
    roots = {r["topic"]: r["root"] for r in stored.roots.collect()}
    read = visits.join(questions.select("question_id", "category"), "question_id").collect()
    assert {r["root"] for r in read if r["category"] == "a"} == {roots["a"]}
    leaves = stored.nodes.where("leaf").count()
    general = [r for r in read if r["category"] == "general"]
    assert len(general) < 12 * leaves / 3, (len(general), leaves)
    assert not [r for r in read if r["category"] in (None, "nowhere")]
    # cells of one direction are cut into blocks, others are small
    assert max(len(r["rows"]) for r in stored.cells.collect()) < 200
    cells.write_cells(chunks.limit(0), str(tmp_path / "e"))
    assert cells.search(questions, cells.read_cells(spark, str(tmp_path / "e")), 5)[0].count() == 0


@pytest.mark.parametrize("range_chunks,zone_ranges,filtered", [(64, 64, False), (4, 3, False), (4, 3, True), (1, 1, True)])
def test_sparse_top_k_equals_brute_force(spark, index, tmp_path, range_chunks, zone_ranges, filtered):
    import math

    path, docs, asked, questions = index
    df = Counter(w for _, _, body in docs for w in set(body.split()))
    weight = {w: round(math.log((len(docs) - n + 0.5) / (n + 0.5) + 1.0) * 1_000_000) for w, n in df.items()}

    def score(question, body):
        a, b = Counter(question.split()), Counter(body.split())
        return sum(n * b[w] * weight[w] for w, n in a.items() if w in b) or None

    # in batches of any size: a range may have several blocks of one word
    postings.write_sparse(textindex.read_chunks(spark, path).repartition(3), str(tmp_path), range_chunks, zone_ranges)
    stored = postings.read_sparse(spark, str(tmp_path), len(docs))
    got = retrieve.sparse_top_k(stored, questions, 7, "category" if filtered else None)
    assert hits(got) == brute_hits(docs, asked, score, 7, filtered)


def test_the_walk_skips_blocks_and_loses_nothing(spark, tmp_path):
    """Every word is in every range; rare ones decide. Blocks read are counted."""
    rng = random.Random(5)
    common, rare = [f"c{chr(97 + i)}" for i in range(12)], [a + b for a in "pqrstuvw" for b in "abcdefghij"]
    rows = []
    for n in range(2000):
        # rare words lie together, as the texts of one source do
        near = rare[(n // 25) : (n // 25) + 2]
        rows.append((n, "t", " ".join(rng.choices(common, k=20) + rng.choices(near, k=rng.randrange(0, 4)))))
    docs = spark.createDataFrame(rows, "id bigint, topic string, text string")
    path = str(tmp_path / "i-v1")
    textindex.build_index(docs, path)
    chunks = textindex.read_chunks(spark, path)
    postings.write_sparse(chunks, str(tmp_path / "small"), 16, 8)
    stored = postings.read_sparse(spark, str(tmp_path / "small"), 2000)
    asked = [(q, f"{rng.choice(rare)} {rng.choice(rare)} {rng.choice(common)}", "general") for q in range(20)]
    questions = textindex.vectorize(spark.createDataFrame(asked, "question_id bigint, text string, category string"))
    found, visited = postings.walk(questions, stored, 7)
    every = postings.range_scores(
        postings.weighted_words(questions, stored, None),
        questions.select("question_id").crossJoin(stored.blocks.select("topic", "zone", "range").distinct()), stored,
    )
    order = [F.desc("score"), F.col("chunk_id")]
    best = lambda df: {tuple(r) for r in skew.top_n_per_group(df, ["question_id"], order, 7).collect()}
    assert best(found) == best(every)
    words = postings.weighted_words(questions, stored, None)
    heads = stored.blocks.select("topic", "zone", "range", "term").distinct()
    read = visited.join(words, "question_id").join(heads, ["topic", "zone", "range", "term"]).count()
    full = words.join(heads, "term").count()
    assert visited.distinct().count() == visited.count()
    assert read < full / 3, (read, full)
    # the frequent word has blocks in every range, so no task holds all of them
    assert stored.blocks.where(F.col("term") == common[0]).select("range").distinct().count() == 125


def test_postings_are_the_words_of_the_chunks(spark, index):
    chunks = textindex.read_chunks(spark, index[0])
    want = {(r["chunk_id"], t, n) for r in chunks.collect() for t, n in zip(r["sparse_terms"], r["sparse_tf"])}
    got = [tuple(r) for r in textindex.read_postings(spark, index[0]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_vectors_of_a_model_replace_the_offline_ones(spark, index):
    chunks = textindex.read_chunks(spark, index[0])
    given = chunks.select("chunk_id", F.array(F.col("chunk_id").cast("float"), F.lit(1.0).cast("float")).alias("dense"))
    chunks = textindex.attach_vectors(chunks, given)
    asked = spark.createDataFrame([(1, [0.0, 1.0], 1.0)], "question_id bigint, dense array<float>, norm2 double")
    got = retrieve.dense_top_k(chunks, asked, 2).orderBy("pos").collect()
    assert [(r["chunk_id"], r["pos"]) for r in got] == [(0, 1), (1, 2)]


def test_hybrid_prefers_chunks_in_both_lists(spark):
    schema = "question_id bigint, chunk_id bigint, pos bigint"
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    sparse = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 5, 1)], schema)
    got = {(r["question_id"], r["chunk_id"]): r["pos"] for r in retrieve.hybrid_top_k(dense, sparse).collect()}
    assert got == {(1, 11): 1, (1, 10): 2, (1, 12): 3, (2, 5): 1}


def test_prompts_of_accepted_questions_only(spark, index):
    path, docs, _, _ = index
    questions = spark.createDataFrame(
        [(1, docs[7][2], True, "general"), (2, "write code", False, "general"), (3, "music", True, "general")],
        "question_id bigint, question string, intention boolean, category string",
    )
    history = spark.createDataFrame(
        [(1, 1, "user", "before"), (2, 1, "user", "other")], "question_id bigint, position bigint, role string, content string"
    )
    got = stages.answer_prompts(questions, path, F.lit("sys"), history).orderBy("question_id", "part", "position").collect()
    assert [(r["question_id"], r["part"], r["role"]) for r in got] == [
        (1, 0, "system"), (1, 1, "user"), (1, 2, "user"), (1, 2, "user"), (1, 3, "user"),
        (3, 0, "system"), (3, 2, "user"), (3, 2, "user"), (3, 3, "user"),
    ]
    assert got[-2]["content"].startswith("What are the recent developments")
    prompt = got[4]["content"]
    assert prompt.startswith("\n**User Question:** " + docs[7][2])
    assert prompt.count('    "source": "s",\n') == 7 and '    "url": "",' in prompt and '    "repeated_count": 2,' in prompt


def batch_bytes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])


def test_batches_sent_to_python_are_bounded_by_their_bytes(spark):
    """Long rows come in small batches while the index is built or searched, and only then."""
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    largest = lambda: long.mapInArrow(batch_bytes, "bytes long").agg(F.max("bytes")).first()[0]
    before = largest()
    with settings(spark, textindex.BUILD):
        inside = largest()
    assert inside < 2 * int(*BOUNDED_BATCHES.values()) < before == largest()


def test_the_walk_and_the_build_bound_their_batches(spark, tmp_path, monkeypatch):
    seen, name = [], next(iter(BOUNDED_BATCHES))
    keep, write = cells.materialize, textindex.write_sparse
    monkeypatch.setattr(cells, "materialize", lambda df, label: seen.append((label, spark.conf.get(name))) or keep(df, label))
    monkeypatch.setattr(textindex, "write_sparse", lambda *a: seen.append(("sparse", spark.conf.get(name))) or write(*a))
    path, outside = str(tmp_path / "i"), spark.conf.get(name)
    docs = spark.createDataFrame([(i, "a", f"one {i} two three") for i in range(30)], "id bigint, topic string, text string")
    textindex.build_index(docs, path)
    asked = textindex.vectorize(spark.createDataFrame([(1, "one 7")], "question_id bigint, text string"))
    hits = retrieve.dense_index_top_k(cells.read_cells(spark, path), asked, 3)
    assert hits.count() == 3 and spark.conf.get(name) == outside
    bound = BOUNDED_BATCHES[name]
    assert {("sparse", bound), ("first-hits", bound), ("more-hits", bound)} <= set(seen)


def test_queries_on_chunks_build_no_postings_or_cells(spark, monkeypatch):
    """Parts of the index are added when a query reads them, once."""
    base.forget_stages()
    built = []
    for name in ("write_sparse", "write_cells"):
        write = getattr(textindex, name)
        monkeypatch.setattr(textindex, name, lambda *a, _n=name, _w=write: built.append(_n) or _w(*a))
    small = "/root/testdata/sf0.001"
    assert texts.chunk_metadata(spark, small).count() == texts.chunk_dense_dims(spark, small).count() > 0
    assert texts.idf_table(spark, small).count() > 0 and built == []
    facts = texts.index_run_metrics(spark, small).first()
    assert facts["num_chunks"] == texts.chunks(spark, small).count() and built == ["write_sparse", "write_cells"]
    texts.index_build_counts(spark, small)
    assert texts.index_run_metrics(spark, small).first() == facts and len(built) == 2
    base.forget_stages()
