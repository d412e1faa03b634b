import random

import numpy as np
import pytest

from storyline.llm import suffix_family as X


def brute(rows, least):
    data = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for key, text in data:
        if key is not None:
            for p in range(len(text) - least + 1):
                s = text[p : p + least]
                first[s] = min(first.get(s, key), key)
    out = []
    for key, text in data:
        gone = np.zeros(len(text), bool)
        if key is not None:
            for p in range(len(text) - least + 1):
                if first[text[p : p + least]] < key:
                    gone[p : p + least] = True
        out.append((key, len(text), int(gone.sum()), bytes(np.frombuffer(text, np.uint8)[~gone])))
    return sorted(out, key=repr)


def made_rows(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé fgh") for _ in range(rng.randint(20, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[: len(p) - a], "".join(rng.choice("xyz ab") for _ in range(rng.randint(1, 90)))]))
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(old))
            parts.append(old[:cut] + rng.choice(["", "#"]) + old[cut:])
        rows.append((rng.randint(-50, 10**6), rng.choice(["", " "]).join(parts)))
    return rows + [(3, None), (4, ""), (5, "a" * 400), (6, "a" * 300), (rows[0][0], rows[0][1]), (None, rows[1][1]), (None, passages[0] * 3)]


@pytest.mark.parametrize("least", [50, 20])
def test_equals_brute_force(spark, least):
    rows = made_rows(least, 150)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(4)
    for flush_bytes, range_bytes in ((32 << 20, 12 << 20), (1500, 3000)):
        got = X.remove_repeats(docs, least, flush_bytes, range_bytes).collect()
        have = sorted([(r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), bytes(r.kept)) for r in got], key=repr)
        assert have == brute(rows, least)


def test_levels_stay_few():
    family, rng = X.Family(), np.random.default_rng(1)
    for _ in range(300):
        key = np.unique(rng.integers(0, 1 << 40, 50, dtype=np.uint64))
        family.scan(key, key, np.zeros(len(key), np.int64), np.zeros(len(key), bool))
    assert len(family.levels) <= 12


def test_long_text_and_empty_table(spark):
    rng = random.Random(9)
    long_text = "".join(rng.choice("abcdefgh ijk") for _ in range(60000))
    rows = [(1, long_text), (2, "other " + long_text[30000:30200] + " words"), (3, "own words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.starts, r.ends) for r in X.remove_repeats(docs).collect()}
    assert got[1] == got[3] == ([], [])
    (start,), (end,) = got[2]
    assert start <= 6 and end >= 206 and end - start <= 204
    assert X.remove_repeats(docs.limit(0)).count() == 0
