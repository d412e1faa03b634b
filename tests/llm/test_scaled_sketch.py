import hashlib
import random

import numpy as np

from storyline.llm import scaled_sketch as K


def words(rng, n):
    return [f"w{rng.randrange(100000)}" for _ in range(n)]


def test_containment_of_very_unequal_documents():
    rng = random.Random(1)
    large = words(rng, 60000)
    for share in (0.0, 0.5, 1.0):
        own = int(2000 * (1 - share))
        small = large[500 : 500 + 2000 - own] + words(rng, own)
        got = K.likeness(K.sketch(" ".join(small)), K.sketch(" ".join(large)))
        assert abs(got - share) < 0.12


def test_merge_is_the_sketch_of_both():
    rng = random.Random(2)
    for n in (0, 1, 5, 6, 40, 900):
        a, b = words(rng, n), words(rng, 30)
        both = np.union1d(K.shingle_hashes(" ".join(a), 5), K.shingle_hashes(" ".join(b), 5)) >> np.uint64(16)
        assert (K.merge(K.sketch(" ".join(a)), K.sketch(" ".join(b))) == K._kept(np.unique(both), K.FRACTION)).all()


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (key, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_every_row_meets_the_next_one(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), " ".join(words(rng, rng.randint(0, 60)))) for _ in range(300)]
    rows += [(None, "null id ä"), (rows[0][0], "same id"), (rows[0][0], "same id"), (-4, None), (-3, ""), (7, "é" * 50000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    for part_bytes in (1 << 24, 4000):
        got = K.compare_with_edits(docs, part_bytes=part_bytes).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == brute(rows)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id not in (None, rows[0][0])}
    plain = {r.doc_id: r.fingerprint for r in K.sketches(docs).collect() if r.doc_id not in (None, rows[0][0])}
    assert prints == plain and prints[-4] == prints[-3] == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long_rows = [r for r in got if r.n_chars > 200 and r.doc_id != 7]
    assert sum(r.near_edited for r in long_rows) > 5 * sum(r.near_next for r in long_rows)
    one = K.compare_with_edits(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert K.compare_with_edits(docs.limit(0)).count() == 0
