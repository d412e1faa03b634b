import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storyline.llm import stream_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    out = [
        "", "a" * 5000, "a" * 131 + " " + "=" * 3000, "\x1c\x1d x\x85y​z  \n\n q", " 's 'll '''ll x'llama", "é" * 700,
        "<|endoftext|>hi <|endoftext|>", "日本語" * 500, "٠Ⅷ ½ x²", "b" * 70000 + " c", "x " * 40000, " " * 70000 + "y",
        ("word " * 13000) + "  \n " + "tail'll  ",
    ]
    for _ in range(800):
        kinds = [
            chr(rng.randrange(32, 127)), chr(rng.randrange(0, 0x250)), rng.choice(" '\n\t  "), rng.choice("stldmrve"),
            chr(rng.randrange(0x250, 0xD7FF)), chr(rng.randrange(0x1F300, 0x1F700)),
        ]
        out.append("".join(rng.choice(kinds) for _ in range(rng.randint(1, 40))))
    return out + ["".join(rng.choice("ab =-") for _ in range(rng.randint(1, 600))) for _ in range(150)]


def test_ids_and_text_equal_the_library(library):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = B.encoder(PATH).encode(text)
        assert got.tolist() == want, text[:60]
        assert "".join(B.decoder(PATH).decode(got)) == library.decode(want, skip_special_tokens=False)


def test_broken_bytes_decode_as_the_library_does(library):
    rng = random.Random(7)
    single = [n for t, n in B.encoder(PATH).merges.ids.items() if len(t) == 1]
    for n in range(600):
        ids = [rng.choice(single) if n % 2 else rng.randrange(50257) for _ in range(rng.randint(1, 30))]
        small = B.IdDecoder(B.encoder(PATH).merges, block=3)
        assert "".join(small.decode(np.array(ids))) == library.decode(ids, skip_special_tokens=False)


def test_long_words_leave_the_machine_as_they_come():
    coder = B.WordEncoder(B.Transducer(B.encoder(PATH).merges))
    most, count = 0, 0
    for _ in range(200):
        count += sum(len(t) for t in coder.feed(b"abcab" * 100))
        most = max(most, len(coder.last))
    assert count > 90_000 and most < 1200


def test_memo_generations_do_not_change_ids(monkeypatch):
    text = " ".join(f"w{n} x{n % 7}" for n in range(3000))
    want = B.encoder(PATH).encode(text).tolist()
    monkeypatch.setattr(B, "MEMO_PIECES", 50)
    monkeypatch.setattr(B, "MEMO_STATES", 40)
    assert B.TextEncoder(B.encoder(PATH).merges).encode(text).tolist() == want


def test_round_trip_rows(spark):
    rows = [(1, "some words\n", 3), (1, "some words\n", 3), (None, None, 1), (2, "", 1), (3, "ж" * 40000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = B.round_trip(docs, PATH).collect()
    assert len(got) == 5
    by = {r.id: r for r in got}
    assert by[2].n_tokens == by[None].n_tokens == 0
    assert by[3].decoded_sha256 == hashlib.sha256(("ж" * 40000).encode()).hexdigest()
    assert B.round_trip(docs.limit(0), PATH).count() == 0
    assert sorted(map(len, [r.ids for r in B.encode_column(docs, PATH).collect()]))[:2] == [0, 0]
