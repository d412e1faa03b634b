"""Vector bin packing of tokenized examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The
next example for an open sequence is the one whose demand has the largest dot
product with what is left of the three, each as a share of its limit; so scarce
room decides. When nothing fits and more than ``max_padding`` tokens are left, the
best example is cut there and its rest goes on. Examples are packed inside the
task that tokenized them, in pools of a bounded number of tokens; what a pool
leaves over moves to the next one, so only the last sequences of a task can be
part-filled, and these are cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyline.llm.stream_bpe import SPLIT_PATTERN, Merges, TextEncoder

POOL_TOKENS = 1 << 21
END_ID = 1
#: Characters below are the same letters, digits and marks to both libraries.
LATIN_END = "\u0250"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    max_padding: int = 8


class LibraryEncoder(TextEncoder):
    """Ids of the tokenizers library; pieces seen before come from a bounded memo.

    New pieces of Latin letters go through the same merges by ranks, which is several
    times faster for one short piece; all others through the library itself.
    """

    def __init__(self, path: str):
        super().__init__(Merges({}, [], {}))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = Merges.from_file(path)
        order = [merges.ids.get(a + b, -1) for a, b in merges.rank]
        # ranks say the same as the merge list if merges make their ids in order
        by_rank = order == sorted(order) and min(order) >= 256 and sorted(merges.ids.values()) == list(range(len(merges.ids)))
        self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT_PATTERN, mergeable_ranks=merges.ids, special_tokens={}) if by_rank else None
        self.special = [m[:2] for m in merges.special]

    def _encode_piece(self, piece: str) -> bytes:
        if self.ranked and max(piece) < LATIN_END and not any(m in piece for m in self.special):
            return array("I", self.ranked.encode_ordinary(piece)).tobytes()
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()


@functools.cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class Packer:
    """Packs examples as they come; yields (row, start, length, sequence, offset)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.sequence = 0
        self.pool: list[tuple[int, int, int, int]] = []  # row, start, tokens, loss tokens
        self.tokens = 0

    def add(self, row: int, tokens: int, loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Loss-bearing tokens are the last ones of an example."""
        start, most = 0, min(self.limits.tokens, self.limits.loss_tokens)
        while tokens - start >= self.limits.tokens:
            length = self.limits.tokens
            if self._loss(tokens, loss, start, length) > self.limits.loss_tokens:
                length = most
            yield row, start, length, self.sequence, 0
            self.sequence += 1
            start += length
        if start < tokens:
            self.pool.append((row, start, tokens - start, min(loss, tokens - start)))
            self.tokens += tokens - start

    @staticmethod
    def _loss(tokens: int, loss: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, tokens - loss))

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """Full sequences out of the pool; with ``last`` all of it."""
        cap = self.limits
        if not self.pool:
            return
        need = np.array(self.pool, np.int64)
        row, start, size, loss = need[:, 0], need[:, 1], need[:, 2].copy(), need[:, 3].copy()
        start = start.copy()
        alive = np.ones(len(row), bool)
        left_tokens = int(size.sum())
        weight = 1.0 / np.array([cap.tokens, cap.segments, cap.loss_tokens], float) ** 2
        order = np.argsort(-size, kind="stable")  # each sequence begins with a large example
        seed = 0
        while left_tokens >= cap.tokens or (last and left_tokens):
            while not alive[order[seed]]:
                seed += 1
            if left_tokens < cap.tokens:
                break
            room, segments, room_loss, offset, pick = cap.tokens, cap.segments, cap.loss_tokens, 0, order[seed]
            while True:
                take = min(size[pick], room)
                if self._loss(size[pick], loss[pick], 0, take) > room_loss:
                    take = min(take, max(0, size[pick] - loss[pick]) + room_loss)
                used = self._loss(size[pick], loss[pick], 0, take)
                yield int(row[pick]), int(start[pick]), int(take), self.sequence, offset
                room, segments, room_loss = room - take, segments - 1, room_loss - used
                offset += int(take)
                left_tokens -= int(take)
                start[pick] += take
                size[pick] -= take
                loss[pick] = min(loss[pick], size[pick])
                alive[pick] = size[pick] > 0
                if room <= 0 or not segments or not room_loss or not left_tokens:
                    break
                score = size * (room * weight[0]) + segments * weight[1] + loss * (room_loss * weight[2])
                fits = alive & (size <= room) & (loss <= room_loss)
                if fits.any():
                    pick = int(np.argmax(np.where(fits, score, -1.0)))
                elif room > cap.max_padding:
                    pick = int(np.argmax(np.where(alive, score, -1.0)))
                    if not min(size[pick] - loss[pick] + room_loss, room):
                        break
                else:
                    break
            self.sequence += 1
        keep = np.flatnonzero(alive)
        self.pool = [(int(row[i]), int(start[i]), int(size[i]), int(loss[i])) for i in keep]
        self.tokens = left_tokens
        if last:
            yield from self._close()

    def _close(self) -> Iterator[tuple[int, int, int, int, int]]:
        """The rest, in sequences whose lengths are powers of two where the limits let them."""
        cap, rest = self.limits, self.pool[::-1]
        self.pool, total = [], self.tokens
        while rest:
            room = 1 << (min(total, cap.tokens).bit_length() - 1)
            segments, room_loss, offset = cap.segments, cap.loss_tokens, 0
            while rest and room and segments and room_loss:
                row, start, size, loss = rest.pop()
                take = min(size, room, max(0, size - loss) + room_loss)
                room_loss -= self._loss(size, loss, 0, take)
                yield row, start, take, self.sequence, offset
                room, segments, offset, total = room - take, segments - 1, offset + take, total - take
                if take < size:
                    rest.append((row, start + take, size - take, min(loss, size - take)))
            self.sequence += 1
        self.tokens = 0


def pack_documents(
    docs: DataFrame, path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """(id, start, ids binary, doc_tokens, sequence_id, offset) of every piece.

    ``ids`` holds the piece's ids as little-endian 32-bit integers. A document's ids
    are those of its text (null: empty) and the end id; all of them bear loss. Every
    id is in exactly one piece. Repeated ids and null ids stay rows of their own;
    other columns are not read. Sequence ids hold the task's number, so ``docs``
    should be stored rows, whose tasks are the same when they run again.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = library_encoder(path), Packer(limits)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, np.ndarray]] = {}
        number, end = 0, np.array([END_ID], "<u4")

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in range(6)]
            for row, start, length, sequence, offset in pieces:
                key, ids = held[row]
                values = (key, start, ids[start : start + length].tobytes(), len(ids), base + sequence, offset)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            pieces: list = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([coder.encode(text), end])
                held[number] = (key, ids)
                pieces += packer.add(number, len(ids), len(ids))
                number += 1
                if packer.tokens >= pool_tokens:
                    pieces += packer.pack(last=False)
            yield from rows(pieces)
            waiting = {row for row, *_ in packer.pool}
            held = {row: value for row, value in held.items() if row in waiting}
        if id_type is not None:
            yield from rows(packer.pack(last=True))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)
