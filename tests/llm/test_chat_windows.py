import hashlib
import random

import public_tokenizers

from storyline.llm import chat_windows as C
from storyline.llm.stream_bpe import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["\\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "\\\\</turn>", "", " ", " </turn>", "a </turn>\n### b: c", "é\n\n###"]


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    for conv in range(40):
        turn = 0
        if rng.random() < 0.4:
            rows.append((conv, 0, "system", "rule " * rng.randint(0, 20)))
            turn = 1
        for n in range(rng.choice([0, 1, 5, 60 if conv % 9 == 0 else 3])):
            role = rng.choice(["user", "assistant", "odd: role\\"])
            rows.append((conv, turn + n, role, rng.choice([*TRICKY, "word " * rng.randint(1, 120)])))
    return rows + [(77, 1, None, None), (78, 1, "assistant", "x " * 30000), (None, 1, "user", "a"), (None, 1, "user", "a"), (79, None, "assistant", "last"), (79, 0, "system", "s")]


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_turns_come_back():
    for role in ("user", "a: b", "\\", "", "###"):
        for text in TRICKY:
            whole, begin, end = C.format_turn(role, text)
            assert C.parse(whole + whole) == [(role, text)] * 2
            assert C.unescape(whole[begin:end]) == text


def test_read_back_equals_the_input_and_windows_hold(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").repartition(3)
    budget = C.Budget(200, 60)
    made = C.windows(turns, PATH, budget)
    want = by_conversation(rows)
    got = {r.conv_id: r for r in C.read_back(made).collect()}
    assert set(got) == set(want)
    for conv, parts in want.items():
        loss = "".join(t for role, t in parts if role == "assistant")
        assert got[conv].n_turns == len(parts)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    tokens = lambda t: len(encoder(PATH).encode(t))
    count, several = {}, 0
    for r in sorted(made.collect(), key=lambda r: (repr(r.conv_id), r.window_no)):
        parts = [(role, text) for role, text in C.parse(r.text)]
        whole, first = want[r.conv_id], count.get(r.conv_id, 0)
        new = parts[r.repeated :]
        assert whole[first : first + len(new)] == new and new
        assert r.over_budget == (r.n_tokens > 200)
        system = whole[0][0] == "system"
        if r.window_no:
            several += 1
            old = parts[: r.repeated]
            if system:
                assert old[0] == whole[0]
                old = old[1:]
            assert old == whole[first - len(old) : first]
            assert sum(tokens(C.format_turn(*t)[0]) for t in old) <= 60
        if r.over_budget:
            assert len(new) == 1 or (system and len(new) == 2 and r.window_no == 0)
        count[r.conv_id] = first + len(new)
    assert several > 20
    assert C.read_back(C.windows(turns.limit(0), PATH)).count() == 0
