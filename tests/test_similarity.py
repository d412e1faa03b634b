import math
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyline import session
from storyline.operators import blocks, dedup, densejoin, meeting, skew, termjoin
from storyline.plans import stages
from storyline.queries.base import articles


def brute_edges(texts, k, percent):
    sets = {i: set(t.split()) for i, t in texts.items() if t and t.split()}
    result = set()
    for i, a in sets.items():
        found = []
        for j, b in sets.items():
            o = len(a & b)
            if i != j and 10_000 * o * o >= percent * percent * len(a) * len(b):
                found.append((-(o * o) / len(b), j, o, len(a), len(b)))
        for pos, (_, j, o, na, nb) in enumerate(sorted(found)[:k], 1):
            result.add((i, j, pos, o, na, nb))
    return result


def some_texts(seed, n=60):
    rng = random.Random(seed)
    base = [[f"{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(2)] for _ in range(3)]
    texts = {}
    for i in range(n):
        words = list(rng.choice(base)[: rng.choice([6, 20, 24])])
        if rng.random() < 0.6:
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = "z" + rng.choice("abcdefgh")
        rng.shuffle(words)
        texts[i * 3] = " ".join(words)
    texts[1] = ""
    texts[2] = None
    return texts


@pytest.mark.parametrize("posting_limit", [512, 5, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed, posting_limit):
    texts = some_texts(seed)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90, posting_limit, posting_limit)
    got = {tuple(r) for r in got.select("src", "dst", "pos", "overlap", "n_src", "n_dst").collect()}
    assert got == brute_edges(texts, 4, 90)


def test_similar_sets_share_a_filled_part(spark):
    """Pairs at the very threshold, of all sizes, words shared by all or by none."""
    rng = random.Random(12)
    texts, number = {}, 0
    for n in (5, 6, 7, 9, 10, 11, 19, 20, 50, 99, 100, 101, 230, 640):
        for size in range(-(-81 * n // 100), n + 1, max(1, n // 25)):
            # the smallest overlap that reaches the threshold with a set of n words
            overlap = next((o for o in range(size + 1) if 10_000 * o * o >= 8100 * n * size), None)
            if overlap is None or overlap > size:
                continue
            words = rng.sample([f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(11) for b in range(11) for c in range(11)], 2 * n)
            texts[number], texts[number + 1] = " ".join(words[:n]), " ".join(words[:overlap] + words[n : n + size - overlap])
            number += 2
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {tuple(r) for r in termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90).collect()}
    assert got == brute_edges(texts, 4, 90) and len(got) > 100


def test_sketches_rule_out_chance_pairs_alone(spark):
    """Unlike sets that share words by chance go; every pair that reaches the threshold stays."""
    rng = random.Random(6)
    common = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(10)]
    texts = [rng.sample(common, 30) + ["z" + w for w in rng.sample(common, 30)] for _ in range(60)]
    texts += [t[:-2] + ["new"] for t in texts[:20]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, text string")
    reps = termjoin.term_sets(df, "id", "text").select(F.col("id").alias("gid"), "n", "terms")
    every = reps.select(F.col("gid").alias("a"), F.col("n").alias("na")).join(reps.select(F.col("gid").alias("b"), F.col("n").alias("nb")), F.expr("a < b"))
    left = {(r["a"], r["b"]) for r in termjoin.likely_pairs(every, termjoin.set_sketches(reps), 90).collect()}
    near = {(a, b) for a in range(80) for b in range(a + 1, 80) if len(set(texts[a]) & set(texts[b])) ** 2 * 100 >= 81 * len(set(texts[a])) * len(set(texts[b]))}
    assert near <= left and len(near) >= 20 and len(left) < 80 * 79 / 2 / 10


def frequent_sets(n):
    """Unlike sets of words that many sets have, and a near copy of every tenth."""
    rng = random.Random(n)
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(4)]
    texts = [list({w for w in rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=150)}) for _ in range(n)]
    return [" ".join(t) for t in texts] + [" ".join(t[1:]) for t in texts[::10]]


def test_sets_do_not_meet_by_a_part_of_a_frequent_word(spark):
    texts = frequent_sets(400)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    reps = termjoin.term_sets(df, "id", "text").select(F.col("id").alias("gid"), "n", "terms")
    signatures = termjoin._signatures(reps, 90)
    met = signatures.join(termjoin.shared_lists(signatures), "key")
    # the forty near copies, and by chance 7 % of all pairs (with every part as a signature: 13 %)
    assert 40 <= termjoin.candidate_pairs(met, 90).count() < 440 * 439 / 2 * 0.08


def test_sketches_of_large_sets_rule_out_unlike_ones(spark):
    rng = random.Random(8)
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(26) for b in range(26) for c in range(12)]
    texts = [rng.sample(words, 1500 + 40 * i) for i in range(12)]
    texts += [t[:-100] for t in texts]
    reps = termjoin.term_sets(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, text string"), "id", "text")
    reps = reps.select(F.col("id").alias("gid"), "n", "terms")
    every = reps.select(F.col("gid").alias("a"), F.col("n").alias("na")).join(reps.select(F.col("gid").alias("b"), F.col("n").alias("nb")), F.expr("a < b"))
    left = {(r["a"], r["b"]) for r in termjoin.likely_pairs(every, termjoin.set_sketches(reps), 90).collect()}
    assert left == {(i, i + 12) for i in range(12)}


@pytest.mark.parametrize("per_row", [0, 1, 100])
def test_crowded_blocks_of_long_lists_equal_brute_force(spark, monkeypatch, per_row):
    """Blocks that give their likely pairs, and blocks that give the best partners by their words."""
    monkeypatch.setattr(termjoin, "LIKELY_PER_ROW", per_row)
    rng = random.Random(4)
    base = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(6)]
    texts = {i: " ".join([*base[: 57 + i % 3], *(rng.choice("pqrstuvw") * 3 for _ in range(2))]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90, 8, 16)
    assert {tuple(r) for r in got.collect()} == brute_edges(texts, 4, 90)


@pytest.mark.parametrize("most", [500_000, 0])
@pytest.mark.parametrize("copies", [1, 5])
def test_words_of_sets_are_stored_once(spark, monkeypatch, copies, most):
    """Representatives are read from the stored sets, whether ids that stay or ids that go are sent."""
    monkeypatch.setattr(termjoin, "MAX_BROADCAST_ROWS", most)
    labels, keep = [], termjoin.materialize
    monkeypatch.setattr(termjoin, "materialize", lambda df, label, *codec: labels.append((label, df.columns)) or keep(df, label, *codec))
    texts = some_texts(5, 60)
    texts |= {10_000 * c + i: t for c in range(1, copies) for i, t in texts.items()}
    df = spark.createDataFrame([*texts.items()], "id bigint, text string")
    got = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90, 5, 5)
    assert {tuple(r) for r in got.collect()} == brute_edges(texts, 4, 90)
    worded = {label for label, columns in labels if {"words", "terms"} & {*columns}}
    assert worded - {"paired-words"} == ({"term-sets"} if most else {"term-sets", "distinct-sets"})


def test_only_sets_of_crowded_blocks_are_moved(spark, monkeypatch):
    """The words of sets that are in no crowded block stay where they lie."""
    monkeypatch.setattr(termjoin, "LIKELY_PER_ROW", 0)
    rng = random.Random(4)
    base = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(6)]
    texts = {i: " ".join([*base[: 57 + i % 3], *(rng.choice("pqrstuvw") * 3 for _ in range(2))]) for i in range(40)}
    texts |= {i: " ".join("x" * (1 + j) + chr(97 + i % 26) * (1 + i // 26) for j in range(30)) for i in range(40, 140)}
    stored, keep = {}, termjoin.materialize

    def keeping(df, label, *codec):
        stored[label] = keep(df, label, *codec)
        return stored[label]

    monkeypatch.setattr(termjoin, "materialize", keeping)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90, 8, 16)
    assert {tuple(r) for r in got.collect()} == brute_edges(texts, 4, 90)
    assert {r["gid"] for r in stored["crowded-sets"].collect()} <= set(range(40))


def test_stored_steps_leave_no_shuffle_files(spark):
    """What a step shuffled goes when it is stored; the session's setting stays as it was."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in files.getAllFiles().mkString(" ").split() if "shuffle_" in f}
    old, setting = shuffled(), spark.conf.get(session.DROP_SHUFFLES)
    spread = spark.range(5000).repartition(3, "id")
    # written twice: nothing is missed that was dropped
    stored = [session.materialize(spread, "shuffled") for _ in range(2)]
    for _ in range(50):
        left = shuffled() - old
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(session.DROP_SHUFFLES) == setting
    assert [s.count() for s in stored] == [5000, 5000]


def test_texts_are_taken_apart_before_the_joins(spark):
    """Articles without their summary do not move it."""
    plan = articles(spark, "/root/testdata/sf0.001").select("id", "headline")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring_index")


def test_slices_of_batches_hold_bounded_lists():
    lists = [[1] * n for n in (3, 0, 9, 2, 2, 0, 30, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([[5], *lists])], names=["id", "hashes"]).slice(1)
    got = [part.column("hashes").to_pylist() for part in blocks.bounded_slices([batch, batch.slice(0, 0)], "hashes", 8)]
    assert sum(got, []) == lists and all(len(p) == 1 or sum(map(len, p)) <= 8 for p in got) and len(got) < 7


@pytest.mark.parametrize("percent", [50, 80, 90, 97, 100])
def test_bands_and_bound_of_differing_words(percent):
    bounds = termjoin.size_bands(300, percent)
    band = lambda n: max(i for i, b in enumerate(bounds) if b <= n)
    for b in range(1, 301):
        for a in range(1, b + 1):
            least = next((o for o in range(a + 1) if 10_000 * o * o >= percent * percent * a * b), None)
            if least is not None:
                assert band(b) - band(a) <= 1
                assert a + b - 2 * least <= termjoin.differing(b, percent) <= termjoin.differing(bounds[band(b) + 1] - 1, percent)


def test_every_matching_part_but_the_first_of_a_stretch_is_passed_over(spark):
    """Near copies meet a few times, not once for every part that they share."""
    rng = random.Random(3)
    base = [f"{chr(97 + a)}{chr(97 + b)}x" for a in range(20) for b in range(15)]
    rows = [(i, " ".join([*base[: 296], *("q" + rng.choice("abcdefgh") * (j + 1) + str(i) for j in range(2))])) for i in range(40)]
    sets = termjoin.term_sets(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    reps = sets.select(F.col("id").alias("gid"), "n", "terms")
    signatures = termjoin._signatures(reps, 90)
    met = signatures.join(termjoin.shared_lists(signatures), "key")
    a, b = met.alias("a"), met.alias("b")
    joined = a.join(b, "key").where("a.gid < b.gid and (a.home or b.home)")
    parts, starts = joined.count(), joined.where("a.prior != b.prior or a.prior = 0").count()
    assert termjoin.candidate_pairs(met, 90).count() == 40 * 39 // 2
    assert starts < parts / 5


def test_sets_that_share_a_signature_meet_inside_tasks(spark, monkeypatch):
    """Lists give their likely pairs, as the join of all that meet would; pairs met by chance are not moved."""
    monkeypatch.setattr(termjoin, "MET_ROWS", 50)
    monkeypatch.setattr(termjoin, "MET_PAIRS", 20)
    df = spark.createDataFrame(list(enumerate(frequent_sets(400))), "id bigint, text string")
    reps = termjoin.term_sets(df, "id", "text").select(F.col("id").alias("gid"), "n", "terms")
    sketches = termjoin.set_sketches(reps)
    shared = session.materialize(termjoin.shared_signatures(termjoin._signatures(reps, 90)), "shared")
    every = termjoin.candidate_pairs(shared, 90)
    pairs = lambda rows: {(min(a, b), max(a, b)) for a, b in rows}
    likely = pairs(termjoin.likely_pairs(every, sketches, 90).select("a", "b").collect())
    met = termjoin.met_lists(shared, sketches, 90, 512).select("gid", "other").collect()
    assert pairs(met) == likely and len(likely) >= 40 and len(met) < every.count() / 10
    # lists above the limit come as they are
    split = termjoin.met_lists(shared, sketches, 90, 5).cache()
    long = [c for c in shared.columns if c != "other"]
    assert sorted(split.where("other is null").select(long).collect()) == sorted(shared.where("rows > 5").select(long).collect())
    assert pairs(split.where("other is not null").select("gid", "other").collect()) <= likely


def test_passes_make_every_signature_once(spark, monkeypatch):
    """No pass shuffles more than its share; pairs are compared in passes as well."""
    texts = {**some_texts(7, 60), **{100 + i: text for i, text in enumerate(frequent_sets(60))}}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    sets = termjoin.term_sets(df, "id", "text")
    reps = sets.where("n > 0").select(F.col("id").alias("gid"), "n", "terms")
    bounds, weights = termjoin._band_bounds(reps, 90), termjoin.word_weights(reps)
    assert len(termjoin.signature_passes(reps, 90, bounds)) == 1
    monkeypatch.setattr(termjoin, "PASS_SIGNATURES", 200)
    monkeypatch.setattr(termjoin, "PASS_WORDS", 100)
    passes = termjoin.signature_passes(reps, 90, bounds)
    made = [termjoin._signatures(reps, 90, bounds, weights, part).collect() for part in passes]
    every = termjoin._signatures(reps, 90).collect()
    assert sorted(r for rows in made for r in rows) == sorted(every)
    assert len(passes) > 2 and max(map(len, made)) < len(every) / 2
    got = termjoin.neighbour_edges(sets, 4, 90)
    assert {tuple(r) for r in got.collect()} == brute_edges(texts, 4, 90)


def test_hot_words_and_hot_groups_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(termjoin, "hot_limit", lambda rows: 3)
    texts = some_texts(7, 80)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    for posting_limit in (512, 4):
        sets = termjoin.term_sets(df, "id", "text")
        got = termjoin.neighbour_edges(sets, 4, 90, max(posting_limit, 4), 5)
        got = {tuple(r) for r in got.select("src", "dst", "pos", "overlap", "n_src", "n_dst").collect()}
        assert got == brute_edges(texts, 4, 90)


def test_a_mass_of_copies_lists_the_lowest_ids(spark):
    df = spark.range(3000).select("id", F.lit("one two three four five").alias("text"))
    edges = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text")).cache()
    assert edges.count() == 12_000
    lists = defaultdict(list)
    for r in edges.orderBy("src", "pos").collect():
        lists[r["src"]].append(r["dst"])
    assert lists[0] == [1, 2, 3, 4] and lists[2] == [0, 1, 3, 4] and lists[2999] == [0, 1, 2, 3]
    # only listed rows go: five of 3000 copies are hidden, as each hides its own list only
    kept = dedup.keep_representatives(df.select("id"), edges)
    assert {r["id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 4})


def sequential_kept(n, edges):
    listed = defaultdict(set)
    for a, b in edges:
        listed[a].add(b)
    visited, kept = set(), []
    for i in range(n):
        if i in visited:
            continue
        kept.append(i)
        visited |= listed[i]
    return kept


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=40))
def test_fixpoint_equals_the_walk(spark, pairs):
    pairs = {(a, b) for a, b in pairs if a != b}
    edges = spark.createDataFrame(list(pairs), "src bigint, dst bigint")
    kept = dedup.keep_representatives(spark.range(15), edges)
    assert sorted(r["id"] for r in kept.collect()) == sequential_kept(15, pairs)


@pytest.mark.parametrize("task_rows", [1, 4, 30])
def test_pieces_of_any_size_give_the_walk(spark, task_rows):
    rng = random.Random(task_rows)
    n = 40
    pairs = {(a, b) for _ in range(70) if (a := rng.randrange(n)) != (b := rng.randrange(n))}
    pairs |= {(i, i + 1) for i in range(0, 12)} | {(i, 39) for i in range(0, 30, 2)} | {(2, b) for b in range(20, 30)}
    edges = spark.createDataFrame(list(pairs) * 2, "src bigint, dst bigint")
    gone = {r["id"] for r in dedup.dropped_ids(edges, task_rows).collect()}
    assert sorted(set(range(n)) - gone) == sequential_kept(n, pairs)


def test_a_chain_of_a_million_edges_and_a_star(spark, monkeypatch):
    rounds, walk = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, label: rounds.append(label) or walk(df, label))
    n = 1_000_001
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(0, 300_000).select(F.col("id").alias("src"), F.lit(2_000_000).cast("long").alias("dst"))
    gone = dedup.dropped_ids(chain.unionByName(star), 400_000)
    facts = gone.agg(F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 1).alias("odd"), F.max("id").alias("most")).first()
    # 0 is kept, 1 dropped, 2 kept ... and the hub is listed by kept rows
    assert (facts["n"], facts["odd"], facts["most"]) == (500_001, 500_000, 2_000_000)
    assert rounds.count("dedup-dropped") <= 5  # one more than there are pieces at first


def test_chain_keeps_both_ends(spark):
    # a-b and b-c are near, a-c is not: a hides b, c stays
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src bigint, dst bigint")
    kept = dedup.keep_representatives(dedup.duplicate_count(spark.range(3), edges), edges)
    assert {(r["id"], r["duplicate_count"]) for r in kept.collect()} == {(0, 2), (2, 2)}


def brute_nearest(ids, m, k):
    s = m @ m.T
    result = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))
        result[ids[i]] = [ids[j] for j in order[:k]]
    return result


@pytest.mark.parametrize("block_rows", [1000, 16, 7])
def test_nearest_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    m = centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * 0.05
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[60:90] = m[5]
    ids = [int(i) for i in rng.permutation(150) * 2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "id bigint, vec array<double>")
    got = defaultdict(list)
    for r in densejoin.nearest_neighbours(df, 4, block_rows).orderBy("src", "pos").collect():
        got[r["src"]].append(r["dst"])
    assert dict(got) == brute_nearest(ids, m, 4)


@pytest.mark.parametrize("floor", [0.5, 0.97, 0.9999])
def test_a_floor_gives_the_same_list_cut(spark, floor):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(5, 6))[rng.integers(0, 5, 120)] + rng.normal(size=(120, 6)) * 0.15
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[50:56] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    rows = lambda found: {(r["src"], r["dst"], r["pos"]) for r in found.collect()}
    whole = densejoin.threshold_edges(densejoin.nearest_neighbours(df, 4, 8), floor)
    assert rows(densejoin.nearest_neighbours(df, 4, 8, floor=floor)) == rows(whole)


@pytest.mark.parametrize("fan", [2, 5])
def test_a_deep_tree_skips_cells_and_loses_nothing(spark, fan):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 10))
    m = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 10)) * 0.03
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    got = defaultdict(list)
    for r in densejoin.nearest_neighbours(df, 4, 25, fan=fan).orderBy("src", "pos").collect():
        got[r["src"]].append(r["dst"])
    assert dict(got) == brute_nearest(list(range(600)), m, 4)
    tree = densejoin.pivot_tree(df.withColumnRenamed("id", "gid"), 25, fan)
    leaves = tree.nodes.where("leaf").select("node").distinct().count()
    assert tree.depth > 1 and tree.placed.count() == 600
    assert tree.placed.groupBy("cell").count().agg(F.max("count")).first()[0] <= 25
    bounds = tree.placed.select("cell").distinct().withColumn("needed", F.lit(0.15))
    visits = densejoin.cells_to_visit(tree, bounds, True)
    assert visits.count() == visits.distinct().count() < leaves * (leaves - 1) / 2
    # every node's ball holds all rows of the cells below it
    place = {r["cell"]: [] for r in tree.placed.select("cell").collect()}
    for r in tree.placed.collect():
        place[r["cell"]].append(np.array(r["vec"]))
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    for cell, rows_of in place.items():
        node = cell
        while node:
            ball = nodes[node]
            angles = np.arccos(np.clip(np.array(rows_of) @ np.array(ball["pivot"]), -1, 1))
            assert angles.max() <= ball["radius"] + 1e-9
            node = ball["parent"]


@pytest.mark.parametrize("group_rows", [20, 100_000])
def test_cells_are_sent_once_per_group(spark, group_rows):
    m = np.random.default_rng(11).normal(size=(300, 12))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    got = defaultdict(list)
    for r in densejoin.nearest_neighbours(df, 4, 10, group_rows=group_rows).orderBy("src", "pos").collect():
        got[r["src"]].append(r["dst"])
    assert dict(got) == brute_nearest(list(range(300)), m, 4)
    visits = spark.range(40).crossJoin(spark.range(40).withColumnRenamed("id", "cell_b")).withColumnRenamed("id", "cell").where("cell != cell_b")
    sent = densejoin.grouped_visits(visits, 5)
    assert sent.groupBy("cell").count().agg(F.max("count")).first()[0] <= 5
    found = sent.select("cell", F.explode("wanted").alias("cell_b"))
    assert found.count() == visits.count() and found.exceptAll(visits).isEmpty()


def test_cells_meet_in_groups_and_not_pair_by_pair(spark, monkeypatch):
    """Where nothing can be passed over, blocks are sent once per group and not once per cell to visit."""
    m = np.random.default_rng(21).normal(size=(400, 12))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    sent, best = [], densejoin._best_of_pairs
    monkeypatch.setattr(densejoin, "_best_of_pairs", lambda pairs, *a, **b: sent.append(pairs.count()) or best(pairs, *a, **b))
    got = defaultdict(list)
    for r in densejoin.nearest_neighbours(df, 4, 10).orderBy("src", "pos").collect():
        got[r["src"]].append(r["dst"])
    assert dict(got) == brute_nearest(list(range(400)), m, 4)
    cells = densejoin.pivot_tree(df.withColumnRenamed("id", "gid"), 10).placed.select("cell").distinct().count()
    assert sum(sent) < cells * cells / 4


@pytest.mark.parametrize("kind", ["spread", "near", "tight", "raw"])
def test_two_sides_that_meet_find_what_brute_force_does(kind):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(900, 12))
    if kind == "near":
        m[300:] = m[0] + rng.normal(size=(600, 12)) * 0.02
    if kind == "tight":  # single precision does not tell these apart
        m[:] = m[0] + rng.normal(size=(900, 12)) * 0.001
    m = m * rng.uniform(0.01, 50, size=(900, 1)) if kind == "raw" else m / np.linalg.norm(m, axis=1, keepdims=True)
    ids, cells = rng.permutation(900), np.sort(rng.integers(0, 7, 450))
    unknown = np.full(450, -np.inf)
    a, b = (meeting.side(ids[at], m[at], cells, unknown.copy(), 4) for at in (slice(0, 450), slice(450, 900)))
    for pair in ((a, a), (b, b), (a, b)):
        meeting.meet(*pair)
    got = defaultdict(list)
    for src, dst, sim in sorted(zip(*(np.concatenate(x).tolist() for x in zip(a.best(), b.best()))), key=lambda e: (e[0], -round(e[2], 9 if kind != "tight" else 12), e[1])):
        got[src].append((dst, sim))
    products = m @ m.T
    place = {int(i): at for at, i in enumerate(ids)}
    for src, partners in got.items():
        others = np.sort(np.delete(products[place[src]], place[src]))[::-1][:4]
        assert len({dst for dst, _ in partners} - {src}) == 4
        assert np.allclose([sim for _, sim in partners], others, rtol=1e-12, atol=1e-14)
        assert all(abs(products[place[src], place[dst]] - sim) < 1e-9 for dst, sim in partners)
    assert len(got) == 900


def test_only_wanted_cells_meet_and_bounds_hold(monkeypatch):
    monkeypatch.setattr(meeting, "TILE_ROWS", 2)
    m = np.eye(4)[[0, 0, 1, 1]] + 0.01
    a = meeting.side(np.arange(4), m, np.array([0, 0, 1, 1]), np.array([-np.inf, 5.0, -np.inf, -np.inf]), 2)
    b = meeting.side(np.arange(4) + 10, np.vstack([m[:3], [np.nan] * 4]), np.array([0, 0, 1, 1]), np.full(4, -np.inf), 2)
    meeting.meet(a, b, np.array([[True, False], [False, True]]))
    assert set(zip(*(x.tolist() for x in a.best()[:2]))) == {(0, 10), (0, 11), (2, 12), (3, 12)}
    assert set(zip(*(x.tolist() for x in b.best()[:2]))) == {(10, 0), (10, 1), (11, 0), (11, 1), (12, 2), (12, 3)}


def test_raw_inner_product_of_vectors_of_any_length(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(80, 5)) * rng.uniform(0.1, 9, size=(80, 1))
    m[10:14] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vec array<double>")
    got = defaultdict(list)
    for r in densejoin.nearest_neighbours(df, 4, 9, unit=False).orderBy("src", "pos").collect():
        got[r["src"]].append(r["dst"])
    assert dict(got) == brute_nearest(list(range(80)), m, 4)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, vec array<double>")
    got = {(r["src"], r["dst"]) for r in densejoin.nearest_neighbours(df, 4).collect()}
    assert got == {(1, 2), (2, 1)}
    assert densejoin.nearest_neighbours(df.limit(0), 4).count() == 0


def test_rows_without_direction_pass_through(spark):
    data = [(0, "u0", [3.0, 4.0]), (1, "u1", [0.6, 0.8]), (2, "u2", [0.0, 0.0]), (3, "u3", None), (4, "u1", [1.0, 0.0])]
    df = spark.createDataFrame(data, "id bigint, url string, vec array<double>")
    got = stages.deduplicate_by_vectors(df, "vec", F.lit(7)).orderBy("id").collect()
    assert [(r["id"], r["url"], r["duplicate_count"], r["batch_query_time"]) for r in got] == [
        (0, "u0", 2, 7), (1, "u2", 1, 7), (2, "u3", 1, 7),
    ]


def brute_rank(rows, descending):
    result = {}
    for i, g, v in rows:
        if v is None or math.isnan(v):
            result[i] = None
            continue
        others = [w for _, h, w in rows if h == g and w is not None and not math.isnan(w)]
        result[i] = 1 + sum(w > v if descending else w < v for w in others)
    return result


@pytest.fixture(params=[1, 13])
def pieces(spark, request):
    """How many pieces the ordered values are cut into; adaptive execution would join small ones."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "false")
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("descending", [True, False])
def test_rank_in_group(spark, pieces, descending):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        value = None if i % 3 == 0 and i > 300 else rng.choice([None, float("nan"), 0.0, 0.0, 0.0, rng.random(), rng.randrange(9) / 3])
        rows.append((i, "hot" if i % 3 else rng.choice(["a", "b", None]), value))
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = skew.rank_in_group(df, "g", "v", "r", descending)
    assert {r["id"]: r["r"] for r in got.collect()} == brute_rank(rows, descending)
    assert got.columns == ["id", "g", "v", "r"]


def test_running_total(spark, pieces):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["a", None, "hot", "hot", "hot"]), rng.choice([None, *range(90)]), rng.randrange(2))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id int, g string, at int, w int")
    got = skew.running_total(df, "g", "at", F.col("w"), "total")
    place = lambda at: -1 if at is None else at
    want = {i: sum(w2 for _, g2, at2, w2 in rows if g2 == g and place(at2) <= place(at)) for i, g, at, w in rows}
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_a_hot_group_lies_in_many_pieces(spark, pieces, monkeypatch):
    stored = []
    keep = skew.materialize
    monkeypatch.setattr(skew, "materialize", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    ranked = skew.rank_in_group(df, "g", "v", "r", descending=False)
    assert ranked.where("r != v + 1").count() == 0
    sizes = [r["count"] for r in stored[0].groupBy("_part").count().collect()]
    assert len(sizes) == pieces and max(sizes) < 3 * 5000 / pieces
    assert "256" not in ranked._jdf.queryExecution().toString() and len(ranked._jdf.queryExecution().toString()) < 60_000


def test_join_hot_equals_a_plain_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    plain = {tuple(r) for r in left.join(right, "k").collect()}
    assert {tuple(r) for r in skew.join_hot(left, right, ["k"], "n", 50).collect()} == plain


def test_dense_row_id(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("half")).repartition(7)
    got = skew.dense_row_id(df.withColumnRenamed("id", "old"), ["half", "old"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1000))
    assert [(r["half"], r["old"]) for r in got] == sorted((i % 2, i) for i in range(1000))


def test_passes_are_shared_out_by_the_bytes_of_sketches(spark, monkeypatch):
    """Signatures of long sets carry long sketches, so that fewer of them go in one pass."""
    monkeypatch.setattr(termjoin, "PASS_SIGNATURES", 1)
    sizes = [(i, n) for i, n in enumerate([300] * 64 + [3000] * 64)]
    reps = spark.createDataFrame(sizes, "gid bigint, n bigint")
    bounds = termjoin._band_bounds(reps, 90)
    passes = termjoin.signature_passes(reps, 90, bounds)
    carried = lambda n: 64 + termjoin.SKETCH_BITS // 8 * 2 ** int(math.log2(n / termjoin.SKETCH_BITS))
    parts = [0] * len(passes)
    for _, n in sizes:
        for band, _, wanted, signatures in termjoin._visits(np.array([n]), bounds, 90):
            for i, (first, last, _, slices) in enumerate(passes):
                parts[i] += int(wanted[0] and first <= band[0] <= last) * int(signatures[0]) * carried(n) / slices
    assert max(parts) < sum(parts) / 8


def test_words_travel_once_per_block_of_pairs(spark, monkeypatch):
    """A family of near copies has as many pairs as its square; its words move once for each set."""
    every = [(a, b, 300, 300) for a in range(60) for b in range(a + 1, 60)] + [(100, 101, 300, 300), (101, 102, 300, 300)]
    pairs = spark.createDataFrame(every, "a bigint, b bigint, na bigint, nb bigint")
    dealt, members = termjoin.pair_blocks(pairs)
    assert dealt.count() == len(every)
    assert sorted(r["gid"] for r in members.collect()) == [*range(60), 100, 101, 102]
    monkeypatch.setattr(termjoin, "PAIR_BLOCK_WORDS", 10 * (300 + termjoin.SET_WORDS))
    dealt, members = termjoin.pair_blocks(pairs)
    assert sorted((r["a"], r["b"]) for r in dealt.select("a", "b").collect()) == sorted(r[:2] for r in every)
    sets = defaultdict(set)
    for r in members.collect():
        sets[r["key"]].add(r["gid"])
    assert len(sets) > 10 and max(map(len, sets.values())) < 40
    assert all({r["a"], r["b"]} <= sets[r["key"]] for r in dealt.collect())


@pytest.mark.parametrize("words", [1 << 19, 2000])
def test_blocks_of_pairs_give_the_best_partners(spark, monkeypatch, words):
    monkeypatch.setattr(termjoin, "PAIR_BLOCK_WORDS", words)
    monkeypatch.setattr(termjoin, "MET_ROWS", 20)
    monkeypatch.setattr(termjoin, "PASS_WORDS", 500)
    rng = random.Random(9)
    base = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(6)]
    texts = {i: " ".join([*base[: 56 + i % 4], *(rng.choice("pqrstuvw") * 3 for _ in range(2))]) for i in range(50)}
    texts |= {100 + i: t for i, t in some_texts(3, 40).items()}
    stored, keep = {}, termjoin.materialize

    def keeping(df, label, *codec):
        stored.setdefault(label, []).append(keep(df, label, *codec))
        return stored[label][-1]

    monkeypatch.setattr(termjoin, "materialize", keeping)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = termjoin.neighbour_edges(termjoin.term_sets(df, "id", "text"), 4, 90)
    assert {tuple(r) for r in got.collect()} == brute_edges(texts, 4, 90)
    # a pair carries no words, and a block gives no more than the best
    assert sum(d.count() for d in stored["block-sets"]) < stored["likely-pairs"][0].count()
    if words > 2000:
        assert sum(d.count() for d in stored["verified-pairs"]) <= 4 * len(texts)


def test_blocks_of_pairs_keep_rows_of_repeated_ids(spark):
    """Every row of an id is compared, and what is found comes as often as the rows do."""
    words = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d g"), (3, "a b c d e h")]
    reps = spark.createDataFrame(words, "gid bigint, t string").select("gid", F.split("t", " ").alias("terms"))
    pairs = spark.createDataFrame([(1, 2, 5, 6), (1, 3, 5, 6), (2, 3, 6, 6)], "a bigint, b bigint, na bigint, nb bigint")
    for k in (1, 4):
        got = sorted(tuple(r) for r in termjoin._stored_pairs(pairs, reps, k, 80).collect())
        times = min(2, k)
        known = [(1, 2, 5, 6)] * times + [(2, 1, 5, 5)] * times + [(3, 1, 5, 5)] * times
        known += ([(1, 3, 5, 6)] * times + [(2, 3, 5, 6), (3, 2, 5, 6)]) if k == 4 else []
        assert got == sorted(known)
