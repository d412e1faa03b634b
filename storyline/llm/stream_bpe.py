"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

The encoder keeps, for every prefix of the bytes read, the last token of that
prefix's encoding: the one token that ends there and stays apart from the last
token of the prefix before it. A later token can only begin where the bytes read so
far end in a proper prefix of some token, at most ``lookahead`` bytes back (one less
than the longest merge product). The state is therefore that ending and the last
tokens at its places; states and their transitions are made when first met and
shared by all words. A token is stable, and is emitted, once the encodings of all
prefixes that a later token can follow agree on it; what is kept is bounded by the
lookahead, whatever the length of the text.

Texts are cut into words by the vocabulary's split pattern, in blocks whose last
words wait for the next block. Pieces seen before are looked up in a bounded memo.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, and the split pattern of the byte-level vocabularies.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

MEMO_PIECES = 600_000
MEMO_CHARS = 64
MEMO_STATES = 300_000
MEMO_PAIRS = 1_000_000
BLOCK_CHARS = 1 << 16
BEFORE_BLANK = regex.compile("(?= )")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(shifted)}


class Merges:
    """Vocabulary and merge list of a byte-level file, with the lookahead they need."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        self.ids = vocab
        self.special = special
        self.rank = {pair: n for n, pair in enumerate(merges)}
        products = {b"".join(pair) for pair in merges} | {bytes([b]) for b in range(256)}
        self.tokens = {t for t in products if t in vocab}
        self.starts = {t[:n] for t in self.tokens for n in range(len(t))}
        self.id_bytes = {t: n.to_bytes(4, "little") for t, n in vocab.items()}
        self.longest = max(map(len, self.tokens), default=1)
        self.lookahead = self.longest - 1
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda word: bytes(letters[c] for c in word)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = {raw(t): n for t, n in spec["model"]["vocab"].items() if t not in special}
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs], special)

    def merged(self, data: bytes) -> list[bytes]:
        """Encoding of a short byte string by applying the merge list directly."""
        parts = [bytes([b]) for b in data]
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(pair, 1 << 60) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def whole(self, token: bytes) -> bool:
        """The token's own bytes encode to it."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(token) == [token]
        return known

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at the token's last (side 1) or first (side 0) place while it
        is built, from one byte on, each with the rank of the merge that takes it in."""
        known = self._edges[side].get(token)
        if known is None:
            known, part, until = [], token, 1 << 60
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                pair = self.parts[part]
                part, until = pair[side], self.rank[pair]
            self._edges[side][token] = known = known[::-1]
        return known

    def apart(self, left: bytes, right: bytes) -> bool:
        """The two tokens side by side encode to themselves.

        They do not if some merge joins a part at the left token's end with a part at
        the right token's beginning before either is taken in by its own token.
        """
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > MEMO_PAIRS:
                self._apart.clear()
            ends, begins, rank = self._edge(left, 1), self._edge(right, 0), self.rank
            i = j = 0
            known = True
            while True:
                (x, x_until), (y, y_until) = ends[i], begins[j]
                across = rank.get((x, y), 1 << 61)
                # of merges of one rank the left one goes first
                if across < x_until and across <= y_until and across < 1 << 60:
                    known = False
                    break
                if x_until == y_until == 1 << 60:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self._apart[left, right] = known
        return known


class Transducer:
    """The states met so far, and what each byte does to them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.steps: dict[int, tuple[int, bytes]] = {}
        self.states: list[tuple[bytes, tuple]] = []
        self.numbers: dict[tuple, int] = {}
        self._number((b"", (None,)))  # the state before the first byte of a word

    def _number(self, state: tuple[bytes, tuple]) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The next state, and the last token of the prefix that ends with this byte."""
        m = self.merges
        tail, last = self.states[state]
        tail += bytes((byte,))
        for start in range(len(tail)):
            token = tail[start:]
            if token in m.tokens and m.whole(token) and (last[start] is None or m.apart(last[start], token)):
                break
        else:
            raise ValueError("no encoding of a prefix: the vocabulary lacks a single byte")
        last = (*last, token)
        skip = next(n for n in range(len(tail) + 1) if tail[n:] in m.starts)
        found = self.steps[state << 8 | byte] = (self._number((tail[skip:], last[skip:])), token)
        return found


class WordEncoder:
    """Encodes one word fed in pieces; emits tokens as soon as they are stable."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.state = 0
        self.last: list[bytes] = []  # last tokens of the prefixes since the last stable place

    def feed(self, data: bytes) -> Iterator[bytes]:
        block = 2 * self.machine.merges.longest
        for first in range(0, len(data), block):
            state, known, last = self.state, self.machine.steps, self.last
            for byte in data[first : first + block]:
                state, token = known.get(state << 8 | byte) or self.machine.step(state, byte)
                last.append(token)
            self.state = state
            if len(last) >= block:
                yield from self._stable()

    def _path(self, end: int) -> list[int]:
        """Where the tokens of the encoding up to ``end`` end."""
        ends, last = [], self.last
        while end > 0:
            ends.append(end)
            end -= len(last[end - 1])
        return ends[::-1]

    def _stable(self) -> Iterator[bytes]:
        """Tokens on which the encodings of all prefixes agree that a later token can follow."""
        size = len(self.last)
        live = range(size - len(self.machine.states[self.state][0]), size + 1)
        shared = set.intersection(*[set(self._path(end)) for end in live])
        if shared:
            stable = max(shared)
            yield from [self.last[end - 1] for end in self._path(stable)]
            self.last = self.last[stable:]

    def finish(self) -> list[bytes]:
        return [self.last[end - 1] for end in self._path(len(self.last))]


class TextEncoder:
    """Encodes whole texts block by block; ids come out as little-endian 32-bit bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.machine = Transducer(merges)
        self.split = regex.compile(SPLIT_PATTERN)
        self.gap = regex.compile(f"[{SPACE}]")
        self.gap_run = regex.compile(f" [{SPACE}]")
        marks = sorted(merges.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        # two generations, so that frequent pieces outlive the rare ones around them
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_piece(self, piece: str) -> bytes:
        return b"".join([self.memo.get(w) or self._word(w) for w in self.split.findall(piece)])

    def _word(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        if len(self.machine.states) > MEMO_STATES:
            self.machine.reset()
        coder, id_bytes = WordEncoder(self.machine), self.merges.id_bytes
        tokens = [*coder.feed(data), *coder.finish()]
        return b"".join([id_bytes[t] for t in tokens])

    def _piece(self, piece: str) -> bytes:
        """Encoding of a piece that begins and ends at word boundaries."""
        found = self.older.get(piece) or self._encode_piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = found
        return found

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that end at word boundaries.

        A blank before a character that is no white space always begins a word.
        Without one the block goes on, so a boundary is never guessed.
        """
        start = 0
        while len(text) - start > BLOCK_CHARS:
            cut = start + BLOCK_CHARS
            while (cut := text.find(" ", cut)) >= 0:
                if cut + 1 < len(text) and not self.gap.match(text, cut + 1):
                    break
                cut += 1
            if cut < 0:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def blocks(self, text: str) -> Iterator[bytes]:
        """Pieces of the encoding, in order."""
        parts = self.marks.split(text) if self.marks else [text]
        for n, part in enumerate(parts):
            if n % 2:
                yield self.merges.special[part].to_bytes(4, "little")
                continue
            for block in self._blocks(part):
                pieces = block.replace(" ", "\0 ").split("\0") if "\0" not in block else BEFORE_BLANK.split(block)
                if not pieces[0]:
                    del pieces[0]
                if self.gap_run.search(block) or block[-1:] == " ":
                    pieces = self._joined(pieces)
                memo, piece = self.memo.get, self._piece
                yield b"".join([memo(p) or piece(p) for p in pieces])

    def _joined(self, pieces: list[str]) -> list[str]:
        """Pieces whose blank begins no word, as white space or nothing follows it, stay together."""
        out: list[str] = []
        for p in pieces:
            if out and (len(p) == 1 or self.gap.match(p, 1)):
                out[-1] += p
            else:
                out.append(p)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text or "")), "<u4")


class TextDecoder:
    """Bytes to text as they come: a state machine over UTF-8 that never looks back.

    The state is the number of bytes still due and the range the next one must lie
    in; a broken sequence gives one replacement character for its longest valid start.
    """

    def __init__(self):
        self.due, self.low, self.high = 0, 0x80, 0xBF
        self.pending = b""

    def feed(self, data: bytes) -> str:
        whole = self.pending + data
        if not self.pending:
            try:
                return whole.decode("utf-8")
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for byte in data:
            if self.due and self.low <= byte <= self.high:
                self.pending += bytes([byte])
                self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                if not self.due:
                    out.append(self.pending.decode("utf-8"))
                    self.pending = b""
                continue
            if self.due:
                out.append("�")
                self.due, self.low, self.high, self.pending = 0, 0x80, 0xBF, b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.due = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.pending = bytes([byte])
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        left, self.due, self.pending = self.due, 0, b""
        return "�" if left else ""


class IdDecoder:
    """Ids to text, in blocks."""

    def __init__(self, merges: Merges, block: int = 1 << 15):
        self.bytes = {n: t for t, n in merges.ids.items()}
        self.bytes |= {n: t.encode() for t, n in merges.special.items()}
        self.block = block

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        machine = TextDecoder()
        for first in range(0, len(ids), self.block):
            data = b"".join(map(self.bytes.__getitem__, ids[first : first + self.block].tolist()))
            yield machine.feed(data)
        yield machine.finish()


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary file."""
    return TextEncoder(Merges.from_file(path))


@functools.cache
def decoder(path: str) -> IdDecoder:
    return IdDecoder(encoder(path).merges)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) of every row; a null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoder(path).encode(t).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<bigint>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass.

    A null text is empty; repeated ids keep their rows; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encoder(path).encode(text)
                digest = hashlib.sha256()
                for part in decoder(path).decode(ids):
                    digest.update(part.encode("utf-8"))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
