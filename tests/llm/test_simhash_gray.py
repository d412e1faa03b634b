import random

import numpy as np
import xxhash

from storyline.llm import simhash_gray as S
from storyline.operators.components import components


def brute_fp(text, words=4):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not found:
        return 0
    rows = [found] if len(found) < words else [found[i : i + words] for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return {i: min(ids[k] for k in g) for g in groups.values() for i in g}


def made_points(seed, n):
    rng = random.Random(seed)
    fps = []
    for _ in range(n):
        if fps and rng.random() < 0.8:
            fp = rng.choice(fps[-40:])
            for _ in range(rng.randint(0, 5)):
                fp ^= 1 << rng.randrange(64)
        else:
            fp = rng.getrandbits(64)
        fps.append(fp)
    return fps


def test_fingerprint_matches_its_definition():
    for text in ("", None, "one", "A b  C\td\x0be", "x y z w " * 40, "Ä Ö a b c D E f"):
        assert S.simhash(S.shingle_hashes(text, 4)) == brute_fp(text)


def test_links_equal_brute_force_with_and_without_divided_cells(spark):
    fps = list(dict.fromkeys(made_points(3, 700)))
    want = brute_components(list(range(len(fps))), fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    for limit in (4096, 20):
        roots = {r.node: r.root for r in components(S.near_links(points, limit=limit)).collect()}
        got, names = {}, {}
        for i, f in enumerate(signed):
            key = roots.get(f, f)
            names.setdefault(key, i)
            got[i] = names[key]
        assert got == want


def test_rows_that_are_null_empty_repeated_or_clashing(spark):
    rows = [
        (5, None, 1), (3, "", 1), (9, "   ", 2), (None, "a b c d e f g", 3), (7, "A b c d e f g", 3),
        (7, "A b c d e f g", 3), (11, "quite different words stand in here now", 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(tuple(r) for r in S.near_components(docs).select("doc_id", "component_id").na.fill(-1).collect())
    assert got == [(-1, 7), (3, 3), (5, 3), (7, 7), (7, 7), (9, 3), (11, 11)]
    assert S.near_components(docs.limit(0)).count() == 0
