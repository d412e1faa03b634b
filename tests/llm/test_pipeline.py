import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline as P
from storyline.llm import secret_forest
from storyline.llm.simhash_gray import shingle_hashes, simhash
from test_line_templates import brute as brute_lines
from test_simhash_gray import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=3):
    rng = random.Random(seed)
    words = {lang: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(80)] for lang, a in (("en", "abcdefgh"), ("de", "ijklmnöü"))}
    text = lambda lang, n: "\n".join(" ".join(rng.choice(words[lang]) for _ in range(12)) for _ in range(n))
    rows = []
    for n in range(60):
        lang = rng.choice(["en", "de"])
        body = text(lang, rng.randint(2, 9))
        if n % 4 == 0:
            body += "\nthis page is brought to you by our site number " + str(n) + " with all rights reserved"
        if n % 9 == 0:
            body += '\nx token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" y'
        rows.append((n, body, lang, "s", len(body)))
    rows += [(100 + n, rows[5][1], "en", "s", 1) for n in range(3)]
    rows += [(110, None, "en", "s", 0), (111, "", "en", "s", 0), (112, "12 34 !", "en", "s", 7), (113, rows[7][1], None, None, None)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.createDataFrame(made(), COLUMNS), []
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        made_by = stage(spark, docs, str(folder))
        made_by.write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return str(folder), out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage_drops_what_has_no_letters(stages):
    before, after = stages[1][0]
    assert after.columns == before.columns
    assert set(rows(before)) - set(rows(after)) == {110, 111, 112}
    assert rows(after)[113].lang in ("en", "de")


def test_line_stage_equals_brute_force(stages):
    before, after = stages[1][1]
    want = {k: t for k, n, d, t in brute_lines([(r.doc_id, r.text) for r in before.collect()], 5) if not d or t.strip()}
    got = rows(after)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert any(r.text != rows(before)[k].text for k, r in got.items())


def test_near_stage_equals_brute_force(stages):
    before, after = stages[1][2]
    data = [(r.doc_id, simhash(shingle_hashes(r.text, 4))) for r in before.collect()]
    ids = [k for k, _ in data]
    roots = brute_components(ids, [f for _, f in data])
    assert set(rows(after)) == {k for n, k in enumerate(ids) if roots[n] == k}
    assert {100, 101, 102, 113}.isdisjoint(rows(after))


def test_secret_stage_masks_and_keeps_documents(stages):
    before, after = stages[1][3]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for k, r in old.items():
        assert ("token = " in r.text) == ("<SECRET>" in new[k].text)
        if "token = " not in r.text:
            assert r.text == new[k].text


def test_packing_stage_holds_every_id_once(stages, spark):
    before, after = stages[1][4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for k, r in rows(before).items():
        assert [i for _, p in sorted(pieces.pop(k)) for i in p] == library.encode(r.text, add_special_tokens=False).ids + [1]
    assert not pieces
    assert P.run(spark, stages[0]).count() == after.count()


def test_different_texts_of_one_id_or_none_stay(spark):
    rng = random.Random(8)
    text = lambda n=60: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (7, d), (7, e), (7, e), (9, f), (12, f), (None, None), (-4, f)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(None, a), (None, b), (3, c), (7, d), (7, e), (-4, f), (None, None)], key=repr)


def test_near_copies_of_few_bits_go(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [(n, " ".join(words[:-1] + [f"end{n}"])) for n in range(12)]
    prints = [simhash(shingle_hashes(t, 4)) for _, t in rows]
    roots = set(brute_components(list(range(12)), prints).values())
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == sorted(roots) != list(range(12))


CLASHING = "_id _hash _dropped _spans _predicted _sure _row row key kept order n_lines n_dropped _lines component_id fp id hash start spans".split()


def test_columns_of_any_name_are_carried(spark):
    """Each stage keeps other columns and their values, whatever they are called."""
    extra = ", ".join(f"`{c}` string" for c in [*CLASHING, "_ID_", "a b", "x.y"])
    data = [(*r, *[f"{c} {n}" for c in [*CLASHING, "_ID_", "a b", "x.y"]]) for n, r in enumerate(made())]
    docs = spark.createDataFrame(data, f"{COLUMNS}, {extra}")
    plain = docs.select(*COLUMNS.replace(" long", "").replace(" string", "").split(", "))
    for name, stage in P.STAGES[:-1]:
        got, want = stage(spark, docs, "").collect(), stage(spark, plain, "").collect()
        assert len(got) == len(want), name
        assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(repr(tuple(r)) for r in want), name
        before = {tuple(r)[5:] for r in docs.collect()}
        assert all(tuple(r)[5:] in before for r in got), name
    assert P.packing(spark, docs, "").count() == P.packing(spark, plain, "").count()


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(k, t, None, s, n) for k, t, _, s, n in made()], COLUMNS)
    got = P.language_id(spark, docs, "")
    assert {r.doc_id for r in got.collect()} == {k for k, t, *_ in made() if t and any(c.isalpha() for c in t)}
    assert got.columns == docs.columns


def test_secrets_at_the_ends_and_side_by_side(spark):
    found = spark.createDataFrame(
        [(1, 0, 3, True), (1, 3, 5, True), (1, 8, 10, True), (1, 6, 7, False), (2, 0, 2, True), (None, 1, 2, True)],
        "doc_id long, start long, end long, secret boolean",
    )
    docs = spark.createDataFrame([(1, "abcdeäfghi"), (2, "xy"), (None, "pqr"), (4, None), (5, "")], "doc_id long, text string")
    found = found.join(docs, found.doc_id.eqNullSafe(docs.doc_id)).select(found["*"], F.xxhash64("text").alias("text_hash"))
    got = {r.doc_id: r.text for r in secret_forest.redact(docs, found, "#").collect()}
    assert got == {1: "##äfg#", 2: "#", None: "p#r", 4: None, 5: ""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
