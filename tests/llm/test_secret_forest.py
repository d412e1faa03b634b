import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyline.llm import secret_forest as S
from storyline.llm.common import read_table

WORDS = "thing river stone water morning letter garden window people mountain history".split()


@pytest.fixture(scope="module")
def forest(spark):
    dictionary = S.Dictionary(frozenset(WORDS))
    return S.train(spark, S.labelled_findings(WORDS, 120), dictionary), dictionary


def test_candidates_of_odd_texts():
    assert S.candidates(None) == S.candidates("") == S.candidates("no secret here at all") == []
    text = 'é token = "0641917ea4e9feb9cda83477b57ac2654884f485" and password=30eeb55d79857bcce0.'
    assert [text[a:b] for a, b, _ in S.candidates(text)] == ["0641917ea4e9feb9cda83477b57ac2654884f485", "30eeb55d79857bcce0."]
    assert len(S.candidates("a1" * 100000)) == 1


def test_held_out_accuracy(spark, forest):
    model, dictionary = forest
    held = S.labelled_findings([w[::-1] for w in WORDS], 60, seed=99)
    rows = [(S.features(t, a, b, dictionary), float(y)) for t, a, b, y in held]
    frame = spark.createDataFrame(rows, "f array<double>, label double").select(S.array_to_vector("f").alias("features"), "label")
    right = model.transform(frame).where("prediction = label").count()
    assert right / len(rows) > 0.93


def test_rows_and_redaction(spark, forest):
    rng = random.Random(4)
    key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    card = "4337166598464399"
    rows = [
        (1, f"the key {key} und {key}"), (1, "same id, other text"), (None, f"é {key}"), (2, None), (3, ""),
        (4, f"card {card} paid"), (5, 'x token = "0641917ea4e9feb9cda83477b57ac2654884f485" y'), (5, 'x token = "0641917ea4e9feb9cda83477b57ac2654884f485" y'),
    ]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, start int, score int")
    found = S.scored_candidates(docs, *forest)
    clean = S.redact(docs, found)
    assert clean.columns == docs.columns
    got = sorted([(r.doc_id or -1, r.text) for r in clean.collect()], key=repr)
    want = [(k or -1, t and t.replace(key, S.MASK).replace("0641917ea4e9feb9cda83477b57ac2654884f485", S.MASK)) for k, t in rows]
    assert got == sorted(want, key=repr)
    assert found.count() == 6 and S.redact(docs.limit(0), found.limit(0)).count() == 0


def test_corpus_scan_finds_keys_and_leaves_card_numbers(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    found = S.scan(docs).join(docs, "doc_id").select("*", F.expr("substring(text, start + 1, end - start)").alias("value"))
    keys = found.where(F.col("value").rlike("^[0-9a-f]{40}$")).agg(F.count("*"), F.sum(F.col("secret").cast("int"))).first()
    cards = found.where(F.col("value").rlike("^[0-9]{16}$")).agg(F.count("*"), F.sum(F.col("secret").cast("int"))).first()
    assert keys[0] > 0 and keys[1] == keys[0]
    assert cards[0] > 0 and (cards[1] or 0) <= 0.05 * cards[0]


def test_dictionary_counts_words_of_all_documents(spark):
    rng = random.Random(6)
    made = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(n, " ".join(rng.choice(made) for _ in range(3))) for n in range(2500)] + [(None, "Rarely, ünter x 12"), (None, None)]
    counts = Counter(w for _, t in rows for w in re.split("[^a-z]+", (t or "").lower()) if 4 <= len(w) <= 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = sorted(counts, key=lambda w: (-counts[w], w))
    assert S.corpus_words(docs) == want and S.corpus_words(docs, words=50) == want[:50]
