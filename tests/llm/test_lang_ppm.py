import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import lang_ppm as L
from storyline.llm.common import read_table, utf8

import pyarrow as pa


def brute_bits(train_texts, text, symbol):
    """Bits of a text by walking the trees byte by byte, with the symbols as given."""
    S, others = L.SYMBOLS, int((symbol == 0).sum())
    trees = [dict() for _ in range(L.ORDER + 1)]
    for t in train_texts:
        s = [0] * L.ORDER + symbol[list(t.encode())].tolist()
        for i in range(L.ORDER, len(s)):
            for k in range(L.ORDER + 1):
                trees[k].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1

    def prob(context, c):
        if context is None:
            return 1 / S
        shorter = context[1:] if context else None
        node = trees[len(context)].get(context)
        if not node:
            return prob(shorter, c)
        total, distinct = sum(node.values()), len(node)
        if len(node) == S:
            return node[c] / total
        if c in node:
            return node[c] / (total + distinct)
        left = sum(prob(shorter, x) for x in range(S) if x not in node)
        return distinct / (total + distinct) * prob(shorter, c) / left

    s = [0] * L.ORDER + symbol[list(text.encode())].tolist()
    bits = 0.0
    for i in range(L.ORDER, len(s)):
        bits -= math.log2(prob(tuple(s[i - L.ORDER : i]), s[i]))
        bits += math.log2(others) if s[i] == 0 else 0
    return bits


def test_code_lengths_equal_the_trees():
    pairs = [("en", "the cat and the hat"), ("en", "a cat sat"), ("fr", "le chat et la souris"), ("fr", "été à la mer")]
    model = L.train(pairs)
    texts = ["the chat", "", "zzz été \x01", "a" * 30]
    data, ends = utf8(pa.array(texts))
    got = L.code_lengths(model, data, ends)
    for i, text in enumerate(texts):
        for n, lang in enumerate(model.languages):
            want = brute_bits([t for l, t in pairs if l == lang], text, model.symbol)
            assert got[i, n] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_slices_do_not_change_code_lengths(monkeypatch):
    model = L.train([("a", "some words here " * 20), ("b", "andere worte dort " * 20)])
    data, ends = utf8(pa.array(["words " * n for n in range(40)] + [None, "x" * 5000]))
    want = L.code_lengths(model, data, ends)
    monkeypatch.setattr(L, "SLICE_BYTES", 100)
    assert np.allclose(want, L.code_lengths(model, data, ends))


def test_rows_without_letters_null_and_empty(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "the cat and the dog", "en"), (5, "der hund und die katze", "de"), (5, "der hund und die katze", "de")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    model = L.train_on(docs)
    got = L.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(got) == 18
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    clash = docs.withColumn("score", F.lit("old")).withColumn("_text", F.lit(1)).withColumn("_letters", F.lit(2))
    assert sorted(L.predict(clash, model).columns) == sorted([*docs.columns, "_text", "_letters", "lang_pred", "score"])
    assert {r.score for r in L.predict(clash, model, out=("a", "b")).collect()} == {"old"}
    assert L.train_on(docs.limit(0)) is None
    assert L.predict(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    hidden = docs.select(L.held_out().alias("h"), "doc_id").where("doc_id is not null").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in hidden)


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    found = L.predict(docs, L.train_on(docs), ["doc_id", "lang"]).where(L.held_out() & (F.col("lang_pred") != "und"))
    right, all_rows = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert all_rows > 200 and right / all_rows > 0.97
