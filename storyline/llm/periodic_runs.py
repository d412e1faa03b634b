"""Periodic runs of words, found from minimizers at several scales.

A run is a stretch of words that repeats with a smallest period q, is at least two
periods and :data:`LEAST` words long, and cannot be made longer. Periods below
:data:`FIRST_SCALE` are found by comparing the words with themselves at each lag. The
scale P covers the periods from P to 2P - 1: its grams have P/4 words, its windows P
words, and of every window the leftmost gram of least rank is a minimizer. A run of
period p holds two windows that lie p apart and have the same words, hence the same
minimizer; so pairs of equal minimizers at a distance from P to 2P - 1 reach every run.
Each pair is extended both ways as far as the words agree at that distance.

Grams that are themselves periodic recur at every step of their stretch. They rank
behind the others, so that they are minimizers only of windows inside one stretch of a
short period; two stretches with the same repeated words then give the distances at
which they can meet, instead of all pairs of their grams. Other grams recur at most
once in P/8 words, so pairs stay proportional to the words.

Equality of stretches is by 64-bit hashes of words numbered exactly; every run found is
compared word by word afterwards, and where a hash lied, its lag is scanned instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import mix, slices, utf8

LEAST = 12
FIRST_SCALE = 8
#: Texts are worked on together up to so many bytes; a longer one alone.
TOGETHER = 1 << 21

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


class Stretches:
    """Hashes of stretches of a word sequence in constant time each."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        n = len(words)
        steps = np.full(n + 1, self.BASE, np.uint64)
        back = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        values = mix(words.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * np.cumprod(steps, dtype=np.uint64)[:n], out=self.sums[1:])
        self.n = n

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def grams(self, width: int, until: int) -> np.ndarray:
        count = max(0, until - width + 1)
        return (self.sums[width : width + count] - self.sums[:count]) * self.back[:count]

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from a and b onwards (or before them), by halving steps; a <= b."""
        length = np.zeros(len(a), np.int64)
        room = self.n - b if forward else a
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            ask = np.flatnonzero(length + step <= room)
            x, y = (a[ask] + length[ask], b[ask] + length[ask]) if forward else (a[ask] - length[ask] - step, b[ask] - length[ask] - step)
            length[ask[self.of(x, step) == self.of(y, step)]] += step
            step >>= 1
        return length


def lag_scan(words: np.ndarray, lag: int) -> Runs:
    """Maximal stretches of at least two periods at one lag, by direct comparison."""
    same = np.zeros(max(0, len(words) - lag) + 2, bool)
    same[1:-1] = words[lag:] == words[: max(0, len(words) - lag)]
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[::2], turns[1::2]
    long_enough = ends - starts >= lag
    starts, ends = starts[long_enough], ends[long_enough] + lag
    return starts, ends, np.full(len(starts), lag, np.int64)


def _distinct(runs: list[Runs]) -> Runs:
    """One run per stretch: of all periods of a stretch the smallest is its own."""
    starts, ends, periods = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in zip(*runs, strict=True))
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    first = np.ones(len(starts), bool)
    first[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    return starts[first], ends[first], periods[first]


def leftmost_minima(ranks: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost least rank of every window of ``width`` ranks, each once."""
    if len(ranks) < width:
        return np.zeros(0, np.int64)
    place, least, span = np.arange(len(ranks)), ranks, 1
    while span < width:
        shift = min(span, width - span)
        right = least[shift:] < least[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
        least = np.minimum(least[shift:], least[:-shift])
        span += shift
    return place[np.flatnonzero(np.diff(place, prepend=-1))]


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def _gram_pairs(places: np.ndarray, grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal grams at a distance from ``scale`` to twice that, less one."""
    order = np.argsort(grams, kind="stable")
    places, grams = places[order], grams[order]
    at, lags, left, apart = [], [], np.arange(len(places)), 0
    while len(left):
        apart += 1
        left = left[left + apart < len(places)]
        distance = places[left + apart] - places[left]
        near = (grams[left + apart] == grams[left]) & (distance < 2 * scale)
        left, distance = left[near], distance[near]
        wide = distance >= scale
        at.append(places[left[wide]])
        lags.append(distance[wide])
    return (np.concatenate(at), np.concatenate(lags)) if at else (places[:0], places[:0])


def _stretch_pairs(hashes: Stretches, runs: Runs, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) at which a window of one short-period stretch can meet one of the next.

    Both windows lie whole in their stretches, which repeat the same words, so the
    distance is known up to multiples of the short period.
    """
    starts, ends, periods = runs
    use = (8 * periods <= scale) & (ends - starts >= scale)
    order = np.lexsort((starts[use], periods[use]))
    starts, ends, periods = (part[use][order].tolist() for part in runs)
    at, lags = [], []
    for i, (a, end, q) in enumerate(zip(starts, ends, periods, strict=True)):
        j = i + 1
        while j < len(starts) and periods[j] == q and starts[j] < end + scale:
            b, b_end = starts[j], ends[j]
            turn = np.flatnonzero(hashes.of(a + np.arange(q), q) == hashes.of(np.array([b]), q))
            if len(turn):
                least = max(scale, b - end + scale)
                least += (b - a - int(turn[0]) - least) % q
                found = np.arange(least, min(2 * scale - 1, b_end - a - scale) + 1, q)
                lags.append(found)
                at.append(np.maximum(a, b - found))
            j += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(lags)) if at else (none, none)


def _extended(words: np.ndarray, hashes: Stretches, at: np.ndarray, lags: np.ndarray, scale: int) -> Runs:
    """The stretches around pairs, if two periods long; compared word by word."""
    half, n = scale // 2, hashes.n
    onward = at + lags + half <= n
    onward[onward] = hashes.of(at[onward], half) == hashes.of(at[onward] + lags[onward], half)
    before = ~onward & (at >= half)
    before[before] = hashes.of(at[before] - half, half) == hashes.of(at[before] + lags[before] - half, half)
    at, lags = at[onward | before], lags[onward | before]
    forward, backward = hashes.agree(at, at + lags, True), hashes.agree(at, at + lags, False)
    enough = forward + backward >= lags
    at, lags, forward, backward = at[enough], lags[enough], forward[enough], backward[enough]
    starts, ends, periods = _distinct([(at - backward, at + forward + lags, lags)])
    lied = [
        not np.array_equal(words[a : e - q], words[a + q : e])
        for a, e, q in zip(starts.tolist(), ends.tolist(), periods.tolist(), strict=True)
    ]
    if not any(lied):
        return starts, ends, periods
    true = ~np.array(lied)
    return _distinct([(starts[true], ends[true], periods[true]), *[lag_scan(words, q) for q in np.unique(periods[~true]).tolist()]])


def find_runs(words: np.ndarray, lengths: np.ndarray | None = None) -> Runs:
    """(starts, ends, periods) of all runs, by start, then period.

    ``words`` are numbers, equal for equal words. With ``lengths`` they are several
    sequences, longest first, each followed by a number of its own that is nowhere else.
    """
    if lengths is None:
        lengths = np.array([len(words)])
        words = np.append(words, words.max(initial=0) + 1)
    runs = _distinct([lag_scan(words, lag) for lag in range(1, FIRST_SCALE)])
    hashes, scale = Stretches(words), FIRST_SCALE
    after = np.cumsum(lengths + 1)
    while len(lengths) and 2 * scale <= lengths[0]:
        until = int(after[np.searchsorted(-lengths, -2 * scale, "right") - 1])
        gram = scale // 4
        grams = hashes.grams(gram, until)
        starts, ends, periods = runs
        short = (2 * periods <= gram) & (ends - starts >= gram) & (ends <= until)
        periodic = _covered(starts[short], ends[short] - gram + 1, len(grams))
        ranks = mix(grams) >> np.uint64(1) | periodic.astype(np.uint64) << np.uint64(63)
        chosen = leftmost_minima(ranks, scale - gram + 1)
        chosen = chosen[~periodic[chosen]]
        inside = tuple(part[ends <= until] for part in runs)
        pairs = [_gram_pairs(chosen, grams[chosen], scale), _stretch_pairs(hashes, inside, scale)]
        at, lags = (np.concatenate(part) for part in zip(*pairs, strict=True))
        runs = _distinct([runs, _extended(words, hashes, at, lags, scale)])
        scale *= 2
    starts, ends, periods = runs
    keep = ends - starts >= LEAST
    order = np.lexsort((periods[keep], starts[keep]))
    return starts[keep][order], ends[keep][order], periods[keep][order]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and where each text's begin and end."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, bounds = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real), before[bounds - bounds[0]]


def _texts_runs(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text."""
    words, bounds = _words(texts)
    lengths = np.diff(bounds)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= LEAST]
    line = [part for n, row in enumerate(order.tolist()) for part in (codes[bounds[row] : bounds[row + 1]], [-1 - n])]
    starts, ends, periods = find_runs(np.concatenate([*line, np.zeros(0, np.int64)]).astype(np.int64), lengths[order])
    began = np.concatenate(([0], np.cumsum(lengths[order] + 1)))[:-1]
    which = np.searchsorted(began, starts, "right") - 1
    rows, shift = order[which], bounds[order[which]] - began[which]
    by_row = np.argsort(rows, kind="stable")
    rows, starts, ends, periods, shift = (part[by_row] for part in (rows, starts, ends, periods, shift))
    dropped = _covered(starts + shift + periods, ends + shift, len(codes))
    kept = np.concatenate(([0], np.cumsum(~dropped)))
    lines = pa.ListArray.from_arrays(pa.array(kept[bounds].astype(np.int32)), words.filter(pa.array(~dropped)))
    fields = [pa.array(part) for part in (starts + shift - bounds[rows], ends - starts, periods)]
    counts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(lengths)))))
    runs = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(lengths), runs, pc.binary_join(lines, " ")]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    Words are parted by ASCII white space and numbered from 0; ``runs`` holds (start,
    length, period) by start, then period. ``collapsed`` is the text with one blank
    between words and without those that any run holds behind its first period.
    A null text is empty: no words, no runs, an empty collapsed text. Repeated rows and
    ids keep their rows; columns other than the two named are not read, so no name
    clashes. A text is worked on whole, in memory proportional to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = utf8(batch.column(1))
            for first, last in slices(ends, TOGETHER):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), *_texts_runs(part.column(1))], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
