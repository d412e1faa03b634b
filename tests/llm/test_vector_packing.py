import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from storyline.llm import vector_packing as V

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_limits(pieces, limits, sizes, loss):
    at, by_row = defaultdict(list), defaultdict(list)
    for row, start, length, sequence, offset in pieces:
        assert length > 0
        at[sequence].append((offset, length, row, start))
        by_row[row].append((start, length))
    for row, size in sizes.items():
        end = 0
        for start, length in sorted(by_row[row]):
            assert start == end
            end += length
        assert end == size
    for parts in at.values():
        end = bearing = 0
        for offset, length, row, start in sorted(parts):
            assert offset == end
            end += length
            bearing += max(0, start + length - max(start, sizes[row] - loss[row]))
        assert end <= limits.tokens and len(parts) <= limits.segments and bearing <= limits.loss_tokens
    return [sum(p[1] for p in parts) for parts in at.values()]


def test_limits_hold_and_padding_is_small():
    rng = random.Random(1)
    for limits in (V.Limits(64, 30, 64, 2), V.Limits(64, 4, 64, 0), V.Limits(64, 8, 20, 0), V.Limits(128, 3, 128, 0)):
        packer, pieces, sizes, loss = V.Packer(limits), [], {}, {}
        for row in range(400):
            sizes[row] = rng.choice([1, 2, 5, rng.randint(1, 60), rng.randint(1, 400)])
            loss[row] = rng.randint(0, sizes[row])
            pieces += packer.add(row, sizes[row], loss[row])
            if packer.tokens > 900:
                pieces += packer.pack(False)
        pieces += packer.pack(True)
        lengths = check_limits(pieces, limits, sizes, loss)
        if limits.max_padding == 2:
            padded = sum(limits.tokens for n in lengths if n & (n - 1)) + sum(n for n in lengths if not n & (n - 1))
            assert padded < 1.02 * sum(sizes.values())


def test_documents(spark):
    rows = [(n, f"text number {n} " * (n * 7 % 400), "x") for n in range(120)] + [(3, "text again", "y"), (None, None, "z"), (500, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    docs = docs.sortWithinPartitions("doc_id", "text")
    got = V.pack_documents(docs, PATH, pool_tokens=5000).collect()
    library = Tokenizer.from_file(PATH)
    whole = sorted(library.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows)
    assert sum(len(r.ids) // 4 for r in got) == sum(map(len, whole))
    joined = defaultdict(list)
    for r in got:
        if r.id not in (3,):
            joined[r.id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for key, text, _ in rows:
        if key != 3:
            ids = [i for _, part, _ in sorted(joined[key]) for i in part]
            assert ids == library.encode(text or "", add_special_tokens=False).ids + [1]
            assert all(n == len(ids) for *_, n in joined[key])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert V.pack_documents(docs.limit(0), PATH).count() == 0


def test_ids_equal_the_library():
    from test_stream_bpe import odd_texts

    library, coder = Tokenizer.from_file(PATH), V.library_encoder(PATH)
    assert coder.ranked is not None
    for text in odd_texts():
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
