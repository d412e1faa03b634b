"""Exact repeated passages by a logarithmic family of sparse suffix arrays.

A string of ``least`` bytes holds ``WINDOW`` suffixes that begin with ``HEAD`` bytes
each; the smallest head hash marks the string's anchor. Equal strings have equal
anchors, so it is enough to index the suffixes at anchors, about one in twelve.

An anchored suffix is ordered by the hash of its head, then by the hash of its
context (all bytes of strings that could hold the head). Suffixes are dealt by head
hash; within a task, each incoming batch is sorted into a suffix array, merge-scanned
against the levels that are there, and kept as a new level; levels of equal size
merge, so there are at most logarithmically many. A level keeps one suffix per head,
that of the smallest document, and whether contexts differ.

* Same head, same context: every string around it is repeated; the larger document
  loses its context.
* Same head, other context: the strings around it differ somewhere. All of them
  (at most ``WINDOW`` per suffix) are then indexed in a second family of the same
  kind, whose suffixes are the whole strings.

Map tasks send one suffix per head, context and flush, so a passage that millions
of documents share sends as many rows as there are flushes. Matches go back to the
documents by id, in packed arrays. A 64-bit context hash joined with the head's, and
128 bits for whole strings, stand for equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import Roller, mix, parts_for, release_finished, slices, spread_key, spread_of, text_bytes, utf8
from storyline.session import materialize

LEAST = 50
FLUSH_BYTES = 24 << 20
SLICE_BYTES = 1 << 20
#: Text bytes per key range of the families, and per bucket of documents.
RANGE_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
KEY_BITS = 44

_first, _second = Roller(1), Roller(2)


def _window_min(h: np.ndarray, width: int, least: Callable) -> np.ndarray:
    """Smallest (or largest) value of every run of ``width`` values."""
    size, out = 1, h
    while size * 2 <= width:
        out = least(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return least(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Anchors of the texts in one slice: place, document row, head hash, context."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int = LEAST):
        self.least, self.ends, head = least, ends, least // 2 + 1
        window = least - head + 1
        n = len(data)
        sizes = np.diff(ends)
        self.sums = _first.sums(data)
        self.smallest = np.zeros(0, np.uint64)
        if n < least:
            self.place = np.zeros(0, np.int64)
        else:
            stop = np.repeat(ends[1:], sizes)  # end of the document of every byte
            heads = _first.windows(self.sums, head)
            whole = np.arange(n - least + 1) + least <= stop[: n - least + 1]
            smallest = _window_min(heads, window, np.minimum)
            smallest = np.where(whole, smallest, np.uint64(0))
            # a head is an anchor if it is the smallest of some whole string around it
            pad = np.concatenate([np.zeros(window - 1, np.uint64), smallest, np.zeros(window - 1, np.uint64)])
            best = _window_min(pad, window, np.maximum)
            self.place, self.smallest = np.flatnonzero(best == heads), smallest
        self.row = np.searchsorted(ends, self.place, "right") - 1
        self.head = heads[self.place] if n >= least else np.zeros(0, np.uint64)
        self.start = np.maximum(ends[self.row], self.place - (window - 1))
        self.end = np.minimum(ends[self.row + 1], self.place + head + window - 1)
        context = _first.ranges(self.sums, self.start, self.end)
        left = (self.place - self.start).astype(np.uint64)
        self.context = mix(context + left * np.uint64(0x9FB21C651E98DF25))

    def covered(self, chosen: np.ndarray, shorter: int = 0) -> np.ndarray:
        """Places in the contexts of the chosen anchors, or those that begin ``shorter`` bytes
        before a context's end at the latest."""
        change = np.zeros(len(self.sums), np.int32)
        np.add.at(change, self.start[chosen], 1)
        np.add.at(change, self.end[chosen] - shorter, -1)
        return np.cumsum(change[:-1]) > 0

    def strings(self, data: np.ndarray, opened: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, row and two hashes of the whole strings whose own anchor is ``opened``.

        Strings inside a ``known`` context are left out: a smaller document has them
        too, and the smallest one that has a string never has it in such a context.
        """
        place = np.flatnonzero(self.covered(np.flatnonzero(opened), self.least - 1) & ~self.covered(np.flatnonzero(known), self.least - 1))
        # a string's own anchor is the first one in it that bears its smallest head
        heads, number = np.unique(self.head, return_inverse=True)
        wide = len(self.sums) + 1
        sorted_at = np.argsort(number, kind="stable")
        listed = number[sorted_at] * wide + self.place[sorted_at]
        asked = np.searchsorted(heads, self.smallest[place]) * wide + place
        own = sorted_at[np.minimum(np.searchsorted(listed, asked), max(len(listed) - 1, 0))] if len(place) else place
        place = place[opened[own]]
        one = _first.ranges(self.sums, place, place + self.least)
        two = _second.ranges(_second.sums(data), place, place + self.least)
        return place, np.searchsorted(self.ends, place, "right") - 1, one, two


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the constant ones compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


PACKED = "part int, n int, keys binary, contexts binary, owners binary, many binary"
ANSWERS = "bucket int, kind int, docs binary, hashes binary"
RESOLVED, OPEN, STRING = 0, 1, 2


class Sender:
    """Collects suffixes of one map task and sends them packed by key range.

    Of suffixes with one head and context only that of the smallest document goes
    out; larger documents of this flush are answered on the spot.
    """

    def __init__(self, parts: int, mask: int, shift: int, answer: int):
        self.parts, self.mask, self.shift, self.answer = parts, np.uint64(mask), np.uint64(shift), answer
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, key: np.ndarray, context: np.ndarray, doc: np.ndarray) -> None:
        self.rows.append((key & self.mask, context, doc))
        self.size += len(key)

    def flush(self) -> tuple[list[tuple], list[tuple]]:
        """Packed rows, and answers (kind, docs, hashes) known already."""
        if not self.size:
            return [], []
        key, context, doc = (np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.size = [], 0
        order = np.lexsort((doc, context, key))
        key, context, doc = key[order], context[order], doc[order]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, context[1:] != context[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = doc > doc[first]
        answers = [(RESOLVED if self.answer == OPEN else self.answer, doc[later], context[later])]
        lead = np.flatnonzero(new)
        heads = np.flatnonzero(new_key[lead])
        sizes = np.diff(np.append(heads, len(lead)))
        many = sizes > 1
        # heads met with several contexts: the strings around all of them are compared later
        spread = np.repeat(many, sizes)
        if spread.any():
            answers.append((OPEN, doc[lead][spread], context[lead][spread]))
        at = lead[heads]
        smallest = np.minimum.reduceat(doc[lead], heads)
        key, context = key[at], context[at]
        doc = np.where(many, smallest, doc[at])
        part = ((key >> self.shift) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        packed = []
        for p in range(self.parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                packed.append((p, len(own), _planes(key[own]), _planes(context[own]), _planes(doc[own]), np.packbits(many[own]).tobytes()))
        return packed, answers


class Family:
    """Sorted levels of suffixes, one per head; equal-sized levels merge."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def scan(self, key, context, doc, many) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Merge-scan a batch (sorted, heads distinct) with all levels, then keep it.

        Returns answers (kind, docs, contexts): contexts found again in a larger
        document, and contexts that stand beside others of the same head.
        """
        answers = []
        new = np.ones(len(key), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], key), len(level[0]) - 1)
            hit = np.flatnonzero(level[0][at] == key)
            if not len(hit):
                continue
            new[hit] = False
            at = at[hit]
            old_context, old_doc, old_many = level[1][at], level[2][at], level[3][at]
            b_context, b_doc, b_many = context[hit], doc[hit], many[hit]
            differ = old_many | b_many | (old_context != b_context)
            alike = ~differ
            answers.append((RESOLVED, b_doc[alike & (b_doc > old_doc)], b_context[alike & (b_doc > old_doc)]))
            answers.append((RESOLVED, old_doc[alike & (old_doc > b_doc)], old_context[alike & (old_doc > b_doc)]))
            # sides with several contexts have been opened where they were met
            for side, open_doc, open_context in ((b_many, b_doc, b_context), (old_many, old_doc, old_context)):
                answers.append((OPEN, open_doc[differ & ~side], open_context[differ & ~side]))
            level[2][at] = np.minimum(old_doc, b_doc)
            level[3][at] = differ
        self.levels.append([a[new].copy() for a in (key, context, doc, many)])
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 > len(self.levels[-2][0]):
            top, below = self.levels.pop(), self.levels.pop()
            joined = [np.concatenate(c) for c in zip(below, top)]
            order = np.argsort(joined[0], kind="stable")
            self.levels.append([c[order] for c in joined])
        if not len(self.levels[-1][0]):
            self.levels.pop()
        return [a for a in answers if len(a[1])]


def _answer_rows(answers: Iterable[tuple], buckets: int) -> Iterator[tuple]:
    """Answers packed by kind and bucket of documents."""
    by_kind: dict[int, list] = {}
    for kind, doc, value in answers:
        by_kind.setdefault(kind, []).append((doc, value))
    for kind, parts in by_kind.items():
        doc, value = (np.concatenate(c) for c in zip(*parts))
        bucket = spread_of(doc, buckets)
        order = np.lexsort((doc, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            yield int(b), kind, _planes(doc[own]), _planes(value[own])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


_PACKED = [pa.int32(), pa.int32(), *[pa.binary()] * 4], ["part", "n", "keys", "contexts", "owners", "many"]
_ANSWERS = [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["bucket", "kind", "docs", "hashes"]
#: One row type for both: what is sent to the families has bucket -1.
SENT = f"{ANSWERS}, {PACKED}"


def _sent(packed: list[tuple], answers: Iterable[tuple]) -> pa.RecordBatch:
    rows = [(-1, None, None, None, *p) for p in packed] + [(*a, None, None, None, None, None, None) for a in answers]
    return _batch(rows, _ANSWERS[0] + _PACKED[0], _ANSWERS[1] + _PACKED[1])


def _send_anchors(docs: DataFrame, least: int, parts: int, buckets: int, flush_bytes: int, bits: int) -> DataFrame:
    """Anchored suffixes of every document with an id, and answers known within a flush."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held = Sender(parts, (1 << bits) - 1, bits - 24, OPEN), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = utf8(batch.column(1))
            for first, last in slices(ends, SLICE_BYTES):
                part = data[ends[first] : ends[last]]
                found = Anchors(part, ends[first : last + 1] - ends[first], least)
                sender.add(found.head, found.context, ids[first:last][found.row])
                held += len(part)
                if held >= flush_bytes:
                    packed, answers = sender.flush()
                    yield _sent(packed, _answer_rows(answers, buckets))
                    held = 0
        packed, answers = sender.flush()
        yield _sent(packed, _answer_rows(answers, buckets))

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, SENT)


def _matched(sent: DataFrame, parts: int, buckets: int, answer: int) -> DataFrame:
    """Answers of the families, one family per key range, and those known before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, Family] = {}
        answers: list[tuple] = []
        for batch in batches:
            known = batch.select(_ANSWERS[1])
            known = known.filter(pc.greater_equal(known.column("bucket"), 0))
            if known.num_rows:
                yield known
            for bucket, part, n, keys, contexts, owners, many in zip(*[batch.column(c).to_pylist() for c in ["bucket", *_PACKED[1]]]):
                if bucket >= 0:
                    continue
                found = families.setdefault(part, Family()).scan(
                    _unplanes(keys, np.uint64), _unplanes(contexts, np.uint64), _unplanes(owners, np.int64),
                    np.unpackbits(np.frombuffer(many, np.uint8), count=n).astype(bool),
                )
                answers += [(answer if kind == RESOLVED else kind, d, c) for kind, d, c in found]
        yield _batch(list(_answer_rows(answers, buckets)), *_ANSWERS)

    dealt = sent.repartitionById(parts, F.coalesce("part", F.col("bucket")) % parts)
    return dealt.mapInArrow(run, ANSWERS)


def _known(table: pa.Table, kind: int) -> np.ndarray:
    """Sorted marks of (document, hash) of one kind of answer."""
    rows = [
        _mark(_unplanes(d, np.int64), _unplanes(h, np.uint64))
        for k, d, h in zip(*[table.column(c).to_pylist() for c in ("kind", "docs", "hashes")]) if k == kind
    ]
    return np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)


def _mark(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + value)


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _text_slices(table: pa.Table):
    """(row range, ids, which have an id, bytes, ends) of slices of the documents."""
    ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, ends = utf8(table.column("text"))
    for first, last in slices(ends, SLICE_BYTES):
        yield first, last, ids[first:last], valid[first:last], data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]


def _open_strings(docs: DataFrame, answers: DataFrame, least: int, parts: int, buckets: int) -> DataFrame:
    """Whole strings around the open anchors of each bucket, sent to the second family."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        opened, resolved = _known(right, OPEN), _known(right, RESOLVED)
        sender = Sender(parts, (1 << 64) - 1, 40, STRING)
        for _, _, ids, valid, data, ends in _text_slices(left):
            found = Anchors(data, ends, least)
            mark = _mark(ids[found.row], found.context)
            open_here = _in(opened, mark) & valid[found.row]
            if open_here.any():
                gone = _in(resolved, mark) & valid[found.row]
                _, row, one, two = found.strings(data, open_here & ~gone, gone)
                sender.add(one, two, ids[row])
        packed, known = sender.flush()
        return pa.Table.from_batches([_sent(packed, _answer_rows(known, buckets))])

    text = docs.groupBy("bucket")
    return text.cogroup(answers.groupBy("bucket")).applyInArrow(run, SENT)


def _covered(ids, valid, data, ends, resolved, opened, strings, least) -> np.ndarray:
    """Which bytes lie in a string that begins in a smaller document."""
    if not len(resolved) and not len(strings):
        return np.zeros(len(data), bool)
    found = Anchors(data, ends, least)
    mark = _mark(ids[found.row], found.context)
    gone = _in(resolved, mark) & valid[found.row]
    lost = found.covered(np.flatnonzero(gone))
    if len(strings):
        place, row, _, two = found.strings(data, _in(opened, mark) & ~gone & valid[found.row], gone)
        place = place[_in(strings, _mark(ids[row], two))]
        change = np.bincount(place, minlength=len(data) + 1)
        change[: len(data) + 1] -= np.bincount(place + least, minlength=len(data) + 1)
        lost |= np.cumsum(change[:-1]) > 0
    return lost


def _removed(docs: DataFrame, answers: DataFrame, least: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        resolved, opened, strings = (_known(right, kind) for kind in (RESOLVED, OPEN, STRING))
        out = []
        for first, last, ids, valid, data, ends in _text_slices(left):
            gone = _covered(ids, valid, data, ends, resolved, opened, strings, least)
            for n in range(last - first):
                a, b = int(ends[n]), int(ends[n + 1])
                own = gone[a:b]
                edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                out.append((
                    int(ids[n]) if valid[n] else None, b - a, starts.tolist(), stops.tolist(),
                    data[a:b][~own].tobytes(),
                ))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_batches([_batch(out, kinds, ["doc_id", "n_bytes", "starts", "ends", "kept"])])

    return docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        run, "doc_id long, n_bytes long, starts array<bigint>, ends array<bigint>, kept binary"
    )


def remove_repeats(docs: DataFrame, least: int = LEAST, flush_bytes: int = FLUSH_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept binary) of every document.

    A byte is removed if a string of ``least`` bytes that covers it also begins in a
    document with a smaller doc_id; ``starts`` and ``ends`` are the removed runs, in
    bytes of the UTF-8 text, ``kept`` the rest. A null text is empty. Rows with equal
    ids take nothing from each other; rows with a null id neither lose nor take
    bytes. Other columns are not read.
    """
    total = text_bytes(docs)
    parts, buckets = parts_for(total, range_bytes), parts_for(total, BUCKET_BYTES)
    # heads are cut to a few bits more than their number needs; a false meeting only opens strings
    bits = min(64, max(KEY_BITS, total.bit_length() + 12))
    sent = _send_anchors(docs, least, parts, buckets, flush_bytes, bits)
    answers = materialize(_matched(sent, parts, buckets, RESOLVED), "answers")
    release_finished(docs.sparkSession)  # the suffixes on disk are as large as the texts
    placed = docs.select("doc_id", "text", spread_key("doc_id", buckets).alias("bucket"))
    strings = _open_strings(placed, answers, least, parts, buckets)
    found = materialize(_matched(strings, parts, buckets, STRING).where(F.col("kind") == STRING), "answers")
    release_finished(docs.sparkSession)
    every = answers.unionByName(found)
    return _removed(placed, every, least)
