"""Alignment of two tokenizers' tokens over the same bytes, by an associative monoid.

Where a token of A and one of B end at the same byte, both sequences are cut; what lies
between two cuts is a group, and two tokens are linked if their byte ranges overlap. A
byte range of a text knows its cuts, as a cut is an end that both have in the range, but
not what begins before it or ends behind it. It is therefore a :class:`Fragment`: the
open tokens up to its first cut, the closed groups in between, the open tokens behind
its last cut. Fragments side by side make a fragment again, whichever are put together
first, and an empty one changes nothing.

Texts of up to :data:`CHUNK` bytes are one range. Longer ones are cut into ranges whose
fragments are made in any task and put together by a tree over Spark's tasks. A second
pass over the stored links looks up in how many documents each pair of ids is linked.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyline.llm.common import slices, utf8
from storyline.llm.stream_bpe import SPLIT_PATTERN, Merges
from storyline.session import materialize

CHUNK = 1 << 16
#: Fragments put together by one step of the tree.
FAN_IN = 8
#: Texts are worked on together up to so many bytes; a longer one alone.
TOGETHER = 1 << 21
#: Pairs of ids sent to the tasks at a time; more are looked up slice by slice.
SLICE_PAIRS = 1 << 20


class ByteTokens:
    """A byte-level vocabulary file: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        merges = Merges.from_file(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.bytes = [b""] * self.size
        for token, n in (merges.ids | {t.encode(): n for t, n in merges.special.items()}).items():
            self.bytes[n] = token
        order = [merges.ids.get(a + b, -1) for (a, b) in merges.rank]
        self.fast = None
        if order == sorted(order) and len(set(order)) == len(order):  # ids rise with the merges: they are ranks
            self.fast = tiktoken.Encoding("aligned", pat_str=SPLIT_PATTERN, mergeable_ranks=merges.ids, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)


class PieceTokens:
    """A sentence-piece model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self._bytes(self.model.id_to_piece(n)) for n in range(self.size)]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found, np.int64) for found in self.model.encode(texts, num_threads=1)]


@functools.cache
def vocabularies(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens, np.ndarray, np.ndarray]:
    """Both vocabularies of a worker process, and the byte lengths of their ids."""
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    return a, b, *(np.fromiter(map(len, v.bytes), np.int64, v.size) for v in (a, b))


@functools.cache
def numerals(size: int) -> np.ndarray:
    """Decimal ids with each of the marks behind them, as rows of bytes filled up with zeros."""
    width = len(str(size)) + 1
    rows = [np.array([f"{n}{mark}".encode() for n in range(size)], f"S{width}") for mark in ",|;"]
    return np.stack(rows).view(np.uint8).reshape(3, size, width)


@dataclass
class Tokens:
    """Ids and the bytes at which they end, of both tokenizers, over one byte range."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def part(self, a_from: int, a_to: int, b_from: int, b_to: int) -> Tokens:
        return Tokens(self.a[a_from:a_to], self.a_ends[a_from:a_to], self.b[b_from:b_to], self.b_ends[b_from:b_to])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([getattr(self, f.name), getattr(other, f.name)]) for f in fields(self)])


def no_tokens() -> Tokens:
    return Tokens(*[np.zeros(0, np.int64)] * 4)


def steps(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B have ended at each byte where any ends."""
    ends = np.concatenate([tokens.a_ends, tokens.b_ends])
    order = np.argsort(ends, kind="stable")  # two rising runs: merged in one pass
    ends, is_a = ends[order], order < len(tokens.a)
    last = np.flatnonzero(np.diff(ends, append=-1))
    a_done = np.cumsum(is_a)[last]
    return a_done, last + 1 - a_done


def closed_groups(tokens: Tokens, size_b: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of a range that begins and ends with a cut.

    Returns the groups as bytes (``a1,a2|b1;`` each), where each group's bytes end, at
    which text byte it ends, the linked pairs ``a * size_b + b``, and where each group's
    pairs end. A link is a stretch between two ends that follow each other.
    """
    a_done, b_done = steps(tokens)
    a_now, b_now = np.concatenate(([0], a_done))[:-1], np.concatenate(([0], b_done))[:-1]
    pairs = tokens.a[a_now] * size_b + tokens.b[b_now]
    cuts = np.flatnonzero((a_done > a_now) & (b_done > b_now))
    a_last, b_last = a_done[cuts] - 1, b_done[cuts] - 1
    a_group = np.repeat(np.arange(len(cuts)), np.diff(a_last, prepend=-1))
    b_group = np.repeat(np.arange(len(cuts)), np.diff(b_last, prepend=-1))
    ids = np.empty(len(tokens.a) + len(tokens.b), np.int64)
    marks = np.zeros(len(ids), np.int64)
    a_place = np.arange(len(tokens.a)) + np.concatenate(([0], b_last + 1))[a_group]
    b_place = np.arange(len(tokens.b)) + (a_last + 1)[b_group]
    ids[a_place], ids[b_place] = tokens.a, tokens.b
    marks[a_place[a_last]], marks[b_place[b_last]] = 1, 2
    shown = numbers[marks, ids]
    length = np.cumsum(np.count_nonzero(shown, axis=1))
    shown = shown.ravel()
    return shown[shown != 0], length[b_place[b_last]], tokens.a_ends[a_last], pairs, cuts + 1


def counted(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, and how often it is linked."""
    if times is None:
        return np.unique(pairs, return_counts=True)
    found, place = np.unique(pairs, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


@dataclass
class Fragment:
    """What is known of a byte range: open tokens, closed groups, open tokens.

    Without a cut all its tokens are in ``head``.
    """

    cut: bool
    head: Tokens
    tail: Tokens
    groups: bytes
    n_groups: int
    pairs: np.ndarray
    times: np.ndarray

    COLUMNS = (
        "cut boolean, groups binary, n_groups long, pairs array<long>, times array<long>, "
        + ", ".join(f"{side}_{name} array<long>" for side in ("head", "tail") for name in ("a", "a_ends", "b", "b_ends"))
    )

    @classmethod
    def of(cls, tokens: Tokens, size_b: int, numbers: np.ndarray) -> Fragment:
        a_done, b_done = steps(tokens)
        cuts = np.flatnonzero((np.diff(a_done, prepend=0) > 0) & (np.diff(b_done, prepend=0) > 0))
        none = np.zeros(0, np.int64)
        if not len(cuts):
            return cls(False, tokens, no_tokens(), b"", 0, none, none)
        (a, b), (a_to, b_to) = [(int(a_done[c]), int(b_done[c])) for c in (cuts[0], cuts[-1])]
        head, tail = tokens.part(0, a, 0, b), tokens.part(a_to, len(tokens.a), b_to, len(tokens.b))
        return cls(True, head, tail, *_closed(tokens.part(a, a_to, b, b_to), size_b, numbers))

    def then(self, other: Fragment, size_b: int, numbers: np.ndarray) -> Fragment:
        """This range and the one behind it as one."""
        if not self.cut:
            return Fragment(other.cut, self.head + other.head, other.tail, other.groups, other.n_groups, other.pairs, other.times)
        if not other.cut:
            return Fragment(True, self.head, self.tail + other.head, self.groups, self.n_groups, self.pairs, self.times)
        between = _closed(self.tail + other.head, size_b, numbers)
        parts = [(self.groups, self.n_groups, self.pairs, self.times), between, (other.groups, other.n_groups, other.pairs, other.times)]
        pairs, times = counted(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))
        return Fragment(True, self.head, other.tail, b"".join(p[0] for p in parts), sum(p[1] for p in parts), pairs, times)

    def whole(self, size_b: int, numbers: np.ndarray) -> tuple[bytes, int, np.ndarray, np.ndarray]:
        """Groups, their number, pairs and times of a fragment that is a whole text."""
        between = _closed(self.head, size_b, numbers)
        pairs, times = counted(np.concatenate([between[2], self.pairs]), np.concatenate([between[3], self.times]))
        return between[0] + self.groups, between[1] + self.n_groups, pairs, times

    def row(self) -> dict:
        out = {name: getattr(self, name) for name in ("cut", "groups", "n_groups", "pairs", "times")}
        return out | {f"{side}_{f.name}": getattr(getattr(self, side), f.name) for side in ("head", "tail") for f in fields(Tokens)}

    @classmethod
    def from_row(cls, row) -> Fragment:
        head, tail = (Tokens(*[np.asarray(getattr(row, f"{side}_{f.name}"), np.int64) for f in fields(Tokens)]) for side in ("head", "tail"))
        return cls(bool(row.cut), head, tail, row.groups, int(row.n_groups), *(np.asarray(x, np.int64) for x in (row.pairs, row.times)))


def _closed(tokens: Tokens, size_b: int, numbers: np.ndarray) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    if not len(tokens.a):
        return b"", 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    shown, ends, _, pairs, _ = closed_groups(tokens, size_b, numbers)
    return shown.tobytes(), len(ends), *counted(pairs)


def _lists(bounds: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """One list per row; ``rows`` name those that have one, in order."""
    sizes = np.zeros(n, np.int64)
    sizes[rows] = np.diff(bounds)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


ROW = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
OPEN = "a array<long>, a_ends array<long>, b array<long>, b_ends array<long>"


def _texts_tokens(texts: list[str | None], paths: tuple[str, str]) -> Iterator[tuple[int, Tokens]]:
    """(row, tokens) of the texts that have any and whose bytes both tokenizers give back."""
    a, b, a_size, b_size = vocabularies(*paths)
    rows = [n for n, text in enumerate(texts) if text]
    for n, b_ids in zip(rows, b.ids([texts[n] for n in rows]), strict=True):
        line = " " + texts[n]
        a_ids, data = a.ids(line), line.encode()
        if all(b"".join(map(v.bytes.__getitem__, ids.tolist())) == data for v, ids in ((a, a_ids), (b, b_ids))):
            yield n, Tokens(a_ids, np.cumsum(a_size[a_ids]), b_ids, np.cumsum(b_size[b_ids]))


def _short_columns(found: list[tuple[int, Tokens]], n: int, size_b: int, numbers: np.ndarray) -> list[pa.Array]:
    """The columns of ROW for ``n`` texts of one range each, all in one go: every text ends with a cut."""
    rows = np.array([row for row, _ in found], np.int64)
    n_a, n_b, n_groups = np.zeros((3, n), np.int64)
    digests, none = [""] * n, np.zeros(0, np.int64)
    if not found:
        return [*map(pa.array, (n_a, n_b, n_groups, digests)), *[_lists(np.zeros(1, np.int64), none, rows, n)] * 2]
    sizes = np.array([t.a_ends[-1] for _, t in found])
    before = np.concatenate(([0], np.cumsum(sizes)))
    line = Tokens(*[
        np.concatenate([getattr(t, name) + (start if name.endswith("ends") else 0) for (_, t), start in zip(found, before)])
        for name in ("a", "a_ends", "b", "b_ends")
    ])
    shown, shown_ends, group_ends, pairs, pair_ends = closed_groups(line, size_b, numbers)
    last = np.searchsorted(group_ends, before[1:])  # the group that ends with each text
    n_a[rows], n_b[rows] = [len(t.a) for _, t in found], [len(t.b) for _, t in found]
    n_groups[rows] = np.diff(last, prepend=-1)
    ends = [0, *shown_ends[last].tolist()]
    view = memoryview(shown)
    for k, row in enumerate(rows.tolist()):
        digests[row] = hashlib.sha256(view[ends[k] : ends[k + 1] - 1]).hexdigest()
    text_of = np.repeat(np.arange(len(found)), np.diff(pair_ends[last], prepend=0))
    span = int(pairs.max()) + 1
    keys, times = np.unique(text_of * span + pairs, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(found) + 1) * span)
    lists = [_lists(bounds, values, rows, n) for values in (keys % span, times)]
    return [*map(pa.array, (n_a, n_b, n_groups, digests)), *lists]


def _ranges(tokens: Tokens, chunk: int) -> Iterator[Tokens]:
    """Tokens by the byte range in which they end."""
    bounds = np.arange(0, int(tokens.a_ends[-1]) + chunk, chunk)
    a, b = np.searchsorted(tokens.a_ends, bounds, "right"), np.searchsorted(tokens.b_ends, bounds, "right")
    for n in range(len(bounds) - 1):
        yield tokens.part(a[n], a[n + 1], b[n], b[n + 1])


def _tokenized(docs: DataFrame, paths: tuple[str, str], chunk: int) -> DataFrame:
    """One row per text of one range with its result, one per range of every longer text with its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _, _ = vocabularies(*paths)
        numbers, size_b = numerals(max(a.size, b.size)), b.size
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, ends = utf8(batch.column(1))
            for first, last in slices(ends, TOGETHER):
                part = batch.slice(first, last - first)
                short, wide = [], []
                for row, tokens in _texts_tokens(part.column(1).to_pylist(), paths):
                    (wide if tokens.a_ends[-1] > chunk else short).append((row, tokens))
                done = np.ones(len(part), bool)
                done[[row for row, _ in wide]] = False
                keys = key + np.arange(len(part))
                key += len(part)
                columns = _short_columns(short, len(part), size_b, numbers)
                one = pa.array(np.ones(len(part), np.int64))
                nothing = pa.nulls(len(part), pa.list_(pa.int64()))
                whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(keys * 0), one, *columns, *[nothing] * 4], names)
                yield whole.filter(pa.array(done))
                for row, tokens in wide:
                    ranges = list(_ranges(tokens, chunk))
                    for n, piece in enumerate(ranges):
                        head = [part.column(0).slice(row, 1), *(pa.array([x], pa.int64()) for x in (keys[row], n, len(ranges)))]
                        counts = [pa.array([x], pa.int64()) for x in (len(piece.a), len(piece.b))]
                        empty = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                        arrays = [pa.array([getattr(piece, f.name)], pa.list_(pa.int64())) for f in fields(Tokens)]
                        yield pa.RecordBatch.from_arrays([*head, *counts, *empty, *arrays], names)

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row_key long, chunk long, chunks long, {ROW}, {OPEN}"
    names = [part.split(" ")[0] for part in schema.replace(f"id {kind}", "id x").split(", ")]
    return docs.mapInArrow(run, schema)


def _put_together(ranges: DataFrame, most: int, paths: tuple[str, str]) -> DataFrame:
    """Rows of ROW for the texts of several ranges: fragments, then a tree of them."""
    kind = ranges.schema["id"].dataType.simpleString()
    keys = f"id {kind}, row_key long, chunk long, n_a long, n_b long"

    def constants():
        a, b, _, _ = vocabularies(*paths)
        return b.size, numerals(max(a.size, b.size))

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [Fragment.of(Tokens(*[np.asarray(getattr(r, f.name), np.int64) for f in fields(Tokens)]), *constants()).row() for r in batch.itertuples()]
            yield pd.concat([batch[["id", "row_key", "chunk", "n_a", "n_b"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        joined = functools.reduce(lambda x, y: x.then(y, *constants()), map(Fragment.from_row, group.itertuples()))
        out = group.iloc[:1][["id", "row_key", "chunk"]].reset_index(drop=True)
        out["chunk"] //= FAN_IN
        out["n_a"], out["n_b"] = group.n_a.sum(), group.n_b.sum()
        return pd.concat([out, pd.DataFrame([joined.row()])], axis=1)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                groups, n_groups, pairs, times = Fragment.from_row(r).whole(*constants())
                rows.append((n_groups, hashlib.sha256(groups[:-1]).hexdigest(), pairs, times))
            found = pd.DataFrame(rows, columns=["n_groups", "groups_sha256", "pairs", "times"])
            yield pd.concat([batch[["id", "row_key", "n_a", "n_b"]].reset_index(drop=True), found], axis=1)

    spread = ranges.select("id", "row_key", "chunk", "n_a", "n_b", "a", "a_ends", "b", "b_ends").repartition("row_key", "chunk")
    found = spread.mapInPandas(fragments, f"{keys}, {Fragment.COLUMNS}")
    while most > 1:
        found = found.groupBy("row_key", F.expr(f"chunk div {FAN_IN}")).applyInPandas(together, f"{keys}, {Fragment.COLUMNS}")
        most = -(-most // FAN_IN)
    return found.mapInPandas(finished, f"id {kind}, row_key long, {ROW}")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A encodes a blank and the text, B the text, to which it adds the blank itself. The
    count of a pair of ids is the number of rows that hold it linked; ``n_best`` counts
    the links whose pair has the highest count of its A id, ties included, and
    ``count_sum`` adds up the counts of all links. A null or empty text, or one whose
    bytes one of the tokenizers does not give back, has zeros and an empty digest.
    Repeated ids keep their rows, equal rows count each; only the two named columns are
    read. A text is tokenized whole by one task; above ``chunk`` bytes the rest of the
    work on it is spread.
    """
    paths = (path_a, path_b)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stored = materialize(_tokenized(rows, paths, chunk), "tokens")
    most = stored.agg(F.max("chunks")).first()[0] or 1
    names = ["id", "row_key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    whole = stored.where("chunks = 1").select(names)
    if most > 1:
        whole = whole.unionByName(materialize(_put_together(stored.where("chunks > 1"), most, paths), "alignments"))

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    per_a = Window.partitionBy(F.expr(f"pair div {size_b}"))
    counts = whole.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("rows"))
    counts = materialize(counts.withColumn("best", (F.col("rows") == F.max("rows").over(per_a)).cast("int")), "pairs")
    links = whole.select("row_key", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    links = links.select("row_key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    parts, looked_up = -(-counts.count() // SLICE_PAIRS), None
    for n in range(max(parts, 1)):
        mine = F.pmod(F.xxhash64("pair"), F.lit(max(parts, 1))) == n
        found = links.where(mine).join(F.broadcast(counts.where(mine)), "pair")
        looked_up = found if looked_up is None else looked_up.unionByName(found)
    sums = looked_up.groupBy("row_key").agg(
        F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"),
        F.sum(F.col("times") * F.col("rows")).alias("count_sum"),
    )
    totals = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("n_links", "n_best", "count_sum")]
    out = whole.drop("pairs", "times").join(sums, "row_key", "left")
    return out.select("id", "n_a", "n_b", "n_groups", *totals, "groups_sha256")
