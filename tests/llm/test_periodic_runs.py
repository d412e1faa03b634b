import hashlib
import random
import re
import zlib

import numpy as np

from storyline.llm import periodic_runs as R
from storyline.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every lag, every stretch, and no smaller period of the same stretch."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and not any(
                all(words[x] == words[x + r] for x in range(i, j + q - r)) for r in range(1, q)
            ):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    return list(zip(*[part.tolist() for part in R.find_runs(np.array(words, np.int64))], strict=True))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def hard_cases():
    yield from ([], [1], [1] * 11, [1] * 12, [1] * 400, fibonacci(380), [bin(i).count("1") % 2 for i in range(500)])
    # long periods made of short ones: every gram is periodic itself
    yield from (([0, 1] * 40 + [0]) * 4, [1] + ([0, 1] * 20 + [0]) * 2 + [1, 7, 7], ([0] * 40 + [1] + [0] * 39 + [1]) * 3)
    rng = random.Random(11)
    for _ in range(250):
        k, p = rng.choice([1, 2, 2, 3, 5]), rng.randint(1, 40)
        block = [rng.randrange(k) for _ in range(p)]
        if rng.random() < 0.4:
            block = ([rng.randrange(k) for _ in range(rng.randint(1, 4))] * 40)[: p - 1] + block[:1]
        noise = [rng.randrange(k) for _ in range(rng.randint(1, 120))]
        yield noise[:20] + (block * 8)[: rng.randint(p, 4 * p)] + noise + (block * 8)[: rng.randint(p, 4 * p)]


def test_runs_equal_brute_force():
    for words in hard_cases():
        assert found(words) == brute(words), words


def test_a_hash_that_lies_is_found_out(monkeypatch):
    monkeypatch.setattr(R.Stretches, "of", lambda self, start, length: (self.sums[start + length] - self.sums[start]) * self.back[start] & np.uint64(7))
    rng = random.Random(2)
    for _ in range(40):
        words = [rng.randrange(3) for _ in range(90)] + [rng.randrange(9) for _ in range(20)] * 3
        # a lie may lengthen a stretch; what is returned is compared word by word
        for start, end, period in found(words):
            assert words[start : end - period] == words[start + period : end]


def test_minima_are_the_leftmost_of_every_window():
    rng = np.random.default_rng(4)
    for width in (1, 2, 3, 7, 8, 13):
        ranks = rng.integers(0, 6, 60).astype(np.uint64)
        want = sorted({i + int(np.argmin(ranks[i : i + width])) for i in range(60 - width + 1)})
        assert R.leftmost_minima(ranks, width).tolist() == want


def planted(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc_id, len(runs), *tail, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for key in range(400):
        part = [rng.choice("ab cd ef  gh\tä\x0b,".split(" ")) or "\n" for _ in range(rng.randint(0, 30))]
        rows.append((key, " ".join((part * 4)[: rng.randint(0, 90)])))
    rows += [(None, "x " * 15), (None, None), (500, None), (501, ""), (502, " \t\n"), (3, rows[3][1]), (503, "a b\x85c \x1c " * 20)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, runs int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 100
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.word_runs(empty).count() == 0


def test_batches_of_any_size_agree(spark, monkeypatch):
    texts = [("p q r s t u v w x y " * 9) + str(n) for n in range(30)] + ["z " * 5000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted(R.word_runs(docs).collect())
    monkeypatch.setattr(R, "TOGETHER", 50)
    assert sorted(R.word_runs(docs).collect()) == whole
    assert whole[30].runs[0].asDict() == {"start": 0, "length": 5000, "period": 1} and whole[30].collapsed == "z"
