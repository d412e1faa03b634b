"""Chat formatting in budgeted windows.

Turns are marked by a template; control strings inside texts are escaped, so the
text can be read back. A conversation is cut into windows of whole turns: running
sums of turn tokens say how many new turns fit into the budget beside what every
window repeats, the system turn and as many of the last turns as fit into the
history budget. Loss falls on the assistant turns that are new in a window; repeated
ones are masked, so each assistant text bears loss once.

Turns stream through the tasks sorted by conversation and turn. Held is the open
window alone, so a conversation of any length needs no more room than a short one.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.stream_bpe import encoder

#: The marks of a turn, and what inside a text would look like one.
TURN_BEGIN, TURN_END = "### ", " </turn>\n"
CONTROL = ("\\", "###", "</turn>")
ROLE_END = ": "

_ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE_ROLE = re.compile("|".join(map(re.escape, (*CONTROL, ":"))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    re.escape(TURN_BEGIN) + r"((?:[^\\:]|\\.)*+): ((?:[^\\ ]|\\.|(?! </turn>\n) )*+)" + re.escape(TURN_END), re.DOTALL
)


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    history: int = 256


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def escape_role(role: str) -> str:
    return _ESCAPE_ROLE.sub(lambda m: "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its (escaped) text begins and ends in it."""
    head = TURN_BEGIN + escape_role(role) + ROLE_END
    body = escape(text)
    return head + body + TURN_END, len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out, at = [], 0
    while at < len(window):
        match = _TURN.match(window, at)
        if match is None:
            raise ValueError("not a formatted window")
        out.append((unescape(match.group(1)), unescape(match.group(2))))
        at = match.end()
    return out


@dataclass
class Turn:
    role: str
    text: str
    begin: int
    end: int
    tokens: int


@dataclass
class Windows:
    """Cuts one conversation, turn by turn."""

    budget: Budget
    system: list[Turn] = field(default_factory=list)
    turns: list[Turn] = field(default_factory=list)  # history, then new turns
    sums: list[int] = field(default_factory=lambda: [0])  # running sums of their tokens
    repeated: int = 0
    number: int = 0
    seen: int = 0

    def _room(self) -> int:
        return self.budget.tokens - sum(t.tokens for t in self.system)

    def add(self, turn: Turn) -> Iterator[dict]:
        if not self.seen and turn.role == "system":
            self.system = [turn]
            self.seen = 1
            return
        self.seen += 1
        fits = self.sums[-1] + turn.tokens - self.sums[0] <= self._room()
        if not fits and len(self.turns) > self.repeated:
            yield self._window()
            # history: the longest run of whole turns at the end within its own budget
            least = max(self.sums[-1] - self.budget.history, self.sums[-1] + turn.tokens - self._room())
            self._cut(bisect.bisect_left(self.sums, least))
        elif not fits:
            # only history stands before the turn: as much of it goes as the turn needs
            self._cut(min(len(self.turns), bisect.bisect_left(self.sums, self.sums[-1] + turn.tokens - self._room())))
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)

    def _cut(self, first: int) -> None:
        self.turns, self.sums = self.turns[first:], self.sums[first:] or [self.sums[-1]]
        self.repeated = len(self.turns)

    def _window(self) -> dict:
        parts, begins, ends, at = [], [], [], 0
        old = (len(self.system) if self.number else 0) + self.repeated
        for n, turn in enumerate([*self.system, *self.turns]):
            parts.append(turn.text)
            if n >= old and turn.role == "assistant":
                begins.append(at + turn.begin)
                ends.append(at + turn.end)
            at += len(turn.text)
        tokens = self.sums[-1] - self.sums[0] + sum(t.tokens for t in self.system)
        self.number += 1
        return {
            "window_no": self.number - 1, "text": "".join(parts), "loss_begins": begins, "loss_ends": ends,
            "repeated": old, "n_turns": len(parts), "n_tokens": tokens, "over_budget": tokens > self.budget.tokens,
        }

    def finish(self) -> Iterator[dict]:
        if len(self.turns) > self.repeated or (self.system and not self.number):
            yield self._window()


_KINDS = {
    "window_no": pa.int32(), "text": pa.string(), "loss_begins": pa.list_(pa.int64()), "loss_ends": pa.list_(pa.int64()),
    "repeated": pa.int32(), "n_turns": pa.int32(), "n_tokens": pa.int64(), "over_budget": pa.bool_(),
}


def windows(turns: DataFrame, path: str, budget: Budget = Budget()) -> DataFrame:
    """(conv_id, window_no, text, loss_begins, loss_ends, repeated, n_turns, n_tokens, over_budget).

    A conversation's windows stand together and in order. Loss spans are code points of
    ``text``; ``repeated`` counts the leading turns that an earlier window had already.
    A turn too long for the budget stands alone with the system turn, whole, and the
    window says so. Turns come by number (null first), equal numbers by role and text;
    null roles and texts are empty; rows with a null conv_id are one conversation;
    repeated rows are turns of their own. Other columns are not read.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        state, key, key_type = None, None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            out: list[tuple] = []
            for conv, _, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != key:
                    out += [(key, w) for w in state.finish()] if state else []
                    state, key = Windows(budget), conv
                whole, begin, end = format_turn(role, text)
                out += [(key, w) for w in state.add(Turn(role, whole, begin, end, len(coder.encode(whole))))]
            yield _batch(out, key_type)
        if state is not None:
            yield _batch([(key, w) for w in state.finish()], key_type)

    names = "window_no int, text string, loss_begins array<bigint>, loss_ends array<bigint>, repeated int, n_turns int, n_tokens long, over_budget boolean"
    return ordered.mapInArrow(run, f"conv_id {kind}, {names}")


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([k for k, _ in rows], key_type)]
    columns += [pa.array([w[name] for _, w in rows], kind) for name, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *_KINDS])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), out of the windows.

    ``formatted`` must be :func:`windows` output as it comes, conversation by conversation.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, key, key_type, state = False, None, None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            out: list[tuple] = []
            for conv, text, begins, ends, repeated in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_begins", "loss_ends", "repeated")]):
                if not started or conv != key:
                    out += [(key, *state)] if started else []
                    started, key, state = True, conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(begins, ends):
                    plain = unescape(text[a:b])
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield rows(out, key_type)
        if started:
            yield rows([(key, *state)], key_type)

    def rows(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*[(k, n, a.hexdigest(), c, b.hexdigest(), size) for k, n, a, c, b, size in out])) or [[]] * 6
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds)],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    return formatted.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
