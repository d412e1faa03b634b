import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import multi_index as M
from storyline.llm.common import read_table


def brute(ids, vectors, asked, k):
    out = {}
    for q in asked:
        score = vectors @ vectors[q]
        order = sorted((n for n in range(len(ids)) if ids[n] != ids[q]), key=lambda n: (-score[n], ids[n]))[:k]
        out[int(ids[q])] = [(int(ids[n]), float(score[n])) for n in order]
    return out


def test_recall_on_the_table(spark):
    rows = read_table(spark, "/root/testdata/sf0.1", "embeddings").withColumn("score", F.lit("clash"))
    data = rows.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    want = brute(ids, vectors, [n for n in range(len(ids)) if ids[n] % 20 == 0], 20)
    got = {}
    for r in M.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.93
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in exact)


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (300, 4), dtype=np.uint16)
    queries = codes[:40] ^ (1 << rng.integers(0, 16, (40, 4))).astype(np.uint16) * rng.integers(0, 2, (40, 4)).astype(np.uint16)
    for r in (0, 3, 9, 30):
        radius = np.full(40, r)
        differ = np.bitwise_count(codes[None] ^ queries[:, None]).sum(axis=2)
        assert set(zip(*M.probe(codes, queries, radius))) == set(zip(*np.nonzero(differ <= r)))


def test_clustered_codes_are_looked_up_and_not_scanned():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 16, (40, 16), dtype=np.uint16)
    codes = centres[rng.integers(0, 40, 20000)] ^ (rng.random((20000, 16)) < 0.1).astype(np.uint16)
    index, found = M.SubstringIndex(codes), 0
    for q in range(50):
        differ = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        for radius in (0, 12, 33):
            got = index.within(codes[q : q + 1], np.array([radius]))[1]
            assert np.array_equal(got, np.flatnonzero(differ <= radius))
            found += len(got)
    # of 3,000,000 pairs few more are touched than lie within the radius
    assert found <= index.touched < 200_000


def test_a_shard_keeps_ties_by_id_across_batches():
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(10, 8)), 30, axis=0)
    ids = rng.permutation(300)
    model = M.fit(ids, vectors, float(np.linalg.norm(vectors, axis=1).max()), 5, 64)
    query, row, score = M.Shard(model, ids, vectors).best(ids[:40], vectors[:40], 5, True)
    order = np.argsort(ids)
    want = brute(ids[order].tolist(), vectors[order], [int(i) for i in ids[:40]], 5)
    for q in ids[:40]:
        assert row[query == q].tolist() == [i for i, _ in want[int(q)]]


def test_odd_rows_ties_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(n, (rng.normal(size=8) * rng.uniform(0.1, 3)).tolist()) for n in range(60)]
    rows += [(n, [1.0] * 8) for n in range(60, 100)]
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [None] + [1.0] * 7), (280, [float("inf")] * 8), (None, [1.0] * 8), (320, [])]
    short = [(300, [1.0, 2.0]), (301, [0.5])]  # they count as zero where they end
    odd += short
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    full = rows + [(i, v + [0.0] * (8 - len(v))) for i, v in short]
    ids, vectors = np.array([i for i, _ in full]), np.array([v for _, v in full])
    for k in (20, 500):
        got = {}
        for r in M.nearest(table, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        want = brute(ids, vectors, [n for n in range(len(ids)) if ids[n] % 20 == 0], k)
        assert {q: [(i, round(s, 9)) for i, s in v] for q, v in want.items()}.keys() == got.keys()
        for q in want:
            assert len(got[q]) == len(want[q])
            assert len({i for i, _ in got[q]} & {i for i, _ in want[q]}) >= 0.9 * len(want[q])
    assert M.nearest(table.limit(0), F.lit(True)).count() == 0
    assert M.nearest(table.where("vec_id = 60"), F.lit(True)).count() == 0
    assert M.nearest(table.where("vec_id = 200"), F.lit(True)).count() == 0
