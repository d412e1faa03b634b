import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from storyline.llm import token_alignment as T
from storyline.llm.queries import PIECES, VOCABULARY


def library_tokens():
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        a_bytes = {int(n): base64.b64decode(t) for t, n in map(bytes.split, file)}

    def b_bytes(n):
        piece = b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()

    return lambda text: (
        [(n, a_bytes[n]) for n in a.encode(" " + text, add_special_tokens=False).ids], [(n, b_bytes(n)) for n in b.encode(text)],
    )


def brute(rows):
    """Every pair of tokens of every text, by their byte ranges."""
    tokens, out, held, linked = library_tokens(), [], Counter(), []
    for key, text in rows:
        a, b = tokens(text) if text else ([], [])
        data = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, found = 0, []
            for n, part in side:
                found.append((n, at, at + len(part)))
                at += len(part)
            spans.append(found)
        cuts = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        groups, last = [], 0
        for cut in sorted(cuts):
            inside = [",".join(str(n) for n, s, e in side if last <= s and e <= cut) for side in spans]
            groups.append("|".join(inside))
            last = cut
        pairs = Counter((x, y) for x, s, e in spans[0] for y, t, f in spans[1] if max(s, t) < min(e, f))
        held.update(pairs.keys())
        linked.append(pairs)
        out.append((key, len(a), len(b), len(groups), ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [
        (key, n_a, n_b, n_groups, sum(p.values()), sum(t for q, t in p.items() if held[q] == best[q[0]]),
         sum(t * held[q] for q, t in p.items()), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        for (key, n_a, n_b, n_groups, groups), p in zip(out, linked, strict=True)
    ]


def texts():
    rng = random.Random(3)
    words = "the tokenization of Straße naïve 東京タワー 🙂 \x07 <|endoftext|> </s> <0x41> 12345 ''s  \n\t antidisestablishment".split(" ")
    out = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    return out + [None, "", " ", "\n", "x", "▁", "a▁b", "ﬁ ligature", "aaaa" * 90, out[0], "<s>", "é ​"]


@pytest.mark.parametrize("chunk", [1 << 16, 7, 64])
def test_equals_all_pairs_of_ranges(spark, chunk, monkeypatch):
    monkeypatch.setattr(T, "SLICE_PAIRS", 200 if chunk == 7 else 1 << 20)
    rows = [(n if n % 9 else None, t) for n, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, pairs int, row_key int").repartition(3)
    got = [tuple(r) for r in T.align(docs, VOCABULARY, PIECES, chunk=chunk).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_empty_table_and_tables_without_tokens(spark):
    schema = "doc_id long, text string"
    assert T.align(spark.createDataFrame([], schema), VOCABULARY, PIECES).count() == 0
    got = T.align(spark.createDataFrame([(1, None), (1, "")], schema), VOCABULARY, PIECES).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def whole_of(fragment, numbers):
    groups, n, pairs, times = fragment.whole(1000, numbers)
    return groups, n, dict(zip(pairs.tolist(), times.tolist()))


def test_fragments_are_a_monoid():
    rng, numbers = np.random.default_rng(5), T.numerals(1000)
    empty = T.Fragment.of(T.no_tokens(), 1000, numbers)
    for _ in range(60):
        size = int(rng.integers(1, 80))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, 30)), size)) for _ in range(2)]
        tokens = T.Tokens(rng.integers(0, 1000, len(ends[0])), ends[0], rng.integers(0, 1000, len(ends[1])), ends[1])
        want = whole_of(T.Fragment.of(tokens, 1000, numbers), numbers)
        parts = [T.Fragment.of(p, 1000, numbers) for p in T._ranges(tokens, int(rng.integers(1, 12)))]
        while len(parts) > 1:  # in any order of putting together
            k = int(rng.integers(0, len(parts) - 1))
            parts[k : k + 2] = [parts[k].then(parts[k + 1], 1000, numbers)]
        assert whole_of(parts[0], numbers) == want
        assert whole_of(empty.then(parts[0], 1000, numbers), numbers) == want == whole_of(parts[0].then(empty, 1000, numbers), numbers)
