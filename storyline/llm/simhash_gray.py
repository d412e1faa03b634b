"""SimHash near copies: a Gray-order hierarchical index over 64-bit fingerprints.

Equal fingerprints are one point. Two points within ``radius`` bits agree on at
least one of ``radius + 1`` blocks of bits, so each point goes to one cell per
block. A cell with too many points is divided again by blocks of its other bits
(points that agree on all bits but b are at most 2^b, so this ends). Inside a
task the points are sorted by cell and Gray rank, where neighbours share long bit
patterns; runs of 8 points become nodes, runs of 8 nodes upper nodes. A node keeps
the bits its points share. Pairs of nodes are walked from the top, and a pair is
pruned as a whole once the bits on which both agree within themselves differ
between them in more than ``radius`` places. A node with at most ``radius`` free
bits is linked without looking at its pairs. Tasks return one link per point to
its group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.shingles import shingle_hashes
from storyline.operators.components import components
from storyline.session import materialize, shuffle_partitions

RADIUS = 4
CELL_POINTS = 4096
FAN = 8
WALK_PAIRS = 1 << 18


def simhash(hashes: np.ndarray) -> int:
    """Bit i is one if it is set in over half the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; the long holds the 64 bits of the fingerprint.

    Null and empty texts have fingerprint zero. Rows are kept as they are, repeated
    ids and null ids included.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, fp long")


def _blocks(bits: list[int], radius: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(bits, radius + 1) if len(part)]


def _mask(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _cells(points: DataFrame, radius: int, limit: int) -> DataFrame:
    """(cell, fp): each point once per block; crowded cells are divided by their other bits.

    ``cell`` hashes the block's place and value. Two points whose cells merely
    collide are compared for nothing; no link is lost or made up.
    """
    everything = list(range(64))
    blocks = _blocks(everything, radius)
    todo = points.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(b))) for b in blocks])).alias("n", "value"),
    ).select("fp", F.col("n").cast("string").alias("path"), F.xxhash64("n", "value").alias("cell"))
    fixed = {str(n): set(b) for n, b in enumerate(blocks)}
    done = None
    while True:
        counts = todo.groupBy("path", "cell").agg(F.count("*").alias("size"))
        crowded = counts.where(F.col("size") > limit)
        # a division leaves at least 12 bits fewer free; cells of few free bits are small by themselves
        divisible = [p for p, bits in fixed.items() if 64 - len(bits) > 13]
        crowded = materialize(crowded.where(F.col("path").isin(divisible)), "crowded") if divisible else None
        if crowded is None or crowded.isEmpty():
            light = todo.select("cell", "fp")
            return light if done is None else done.unionByName(light)
        todo = materialize(todo, "cells")
        light = todo.join(crowded, ["path", "cell"], "left_anti").select("cell", "fp")
        done = light if done is None else done.unionByName(light)
        heavy = todo.join(crowded, ["path", "cell"], "left_semi")
        parts, deeper = [], {}
        for path in sorted(divisible):
            inner = _blocks([b for b in everything if b not in fixed[path]], radius)
            values = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(b))) for b in inner])
            parts.append(F.when(F.col("path") == path, values))
            deeper |= {f"{path}.{n}": fixed[path] | set(b) for n, b in enumerate(inner)}
        todo = materialize(
            heavy.select("fp", "path", "cell", F.posexplode(F.coalesce(*parts)).alias("n", "value")).select(
                "fp",
                F.concat_ws(".", "path", "n").alias("path"),
                F.xxhash64("cell", "n", "value").alias("cell"),
            ),
            "cells",
        )
        fixed = deeper


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray sequence."""
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _find(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    while True:
        up = parent[rows]
        if (up == rows).all():
            return rows
        parent[rows] = parent[up]
        rows = parent[rows]


def _union(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    while len(x):
        x, y = _find(parent, x), _find(parent, y)
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def linked_groups(cell: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For points sorted by cell and Gray rank: the first point of each one's linked group."""
    n = len(fp)
    parent = np.arange(n)
    if n < 2:
        return parent
    # levels[0] are the points; a node keeps its shared bits (mask), their values and its cells
    levels = [(np.full(n, ~np.uint64(0)), fp, cell, cell)]
    starts = [np.arange(n + 1)]
    while len(levels[-1][1]) > 1:
        mask, value, low, high = levels[-1]
        at = np.arange(0, len(value), FAN)
        both = np.bitwise_and.reduceat(value, at)
        either = np.bitwise_or.reduceat(value, at)
        shared = ~(both ^ either) & np.bitwise_and.reduceat(mask, at)
        levels.append((shared, both & shared, low[at], high[np.minimum(at + FAN, len(value)) - 1]))
        starts.append(np.append(starts[-1][at], n))
    tight = [
        (np.bitwise_count(~mask) <= radius) & (low == high) for mask, _, low, high in levels
    ]
    for level in range(1, len(levels)):
        first, last = starts[level][:-1][tight[level]], starts[level][1:][tight[level]]
        spans = np.repeat(first, last - first)
        inside = np.arange(len(spans)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + spans
        _union(parent, inside, spans)
    top = len(levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if len(x) > WALK_PAIRS:
            half = len(x) // 2
            stack += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
            continue
        mask, value, low, high = levels[level]
        near = (low[y] <= high[x]) & (low[x] <= high[y])
        near &= np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= radius
        x, y = x[near], y[near]
        if level == 0:
            _union(parent, x, y)
            continue
        # nodes already in one group need no further look at their pairs
        both = tight[level][x] & tight[level][y]
        rows = _find(parent, starts[level][x[both]]) == _find(parent, starts[level][y[both]])
        keep = np.ones(len(x), bool)
        keep[np.flatnonzero(both)[rows]] = False
        x, y = x[keep], y[keep]
        size = len(levels[level - 1][1])
        kids = np.arange(FAN)
        cx = np.broadcast_to(x[:, None, None] * FAN + kids[:, None], (len(x), FAN, FAN)).ravel()
        cy = np.broadcast_to(y[:, None, None] * FAN + kids, (len(x), FAN, FAN)).ravel()
        fit = (cx < size) & (cy < size) & (cx <= cy)
        if level == 1:
            fit &= cx < cy
        stack.append((level - 1, cx[fit], cy[fit]))
    return _find(parent, np.arange(n))


def near_links(points: DataFrame, radius: int = RADIUS, limit: int = CELL_POINTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``radius`` bits."""
    spark = points.sparkSession
    cells = _cells(points, radius, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        cell = np.concatenate([g[0] for g in got])
        fp = np.concatenate([g[1] for g in got]).astype(np.int64).view(np.uint64)
        order = np.lexsort((gray_rank(fp), cell))
        cell, fp = cell[order], fp[order]
        group = linked_groups(cell, fp, radius)
        other = fp[group] != fp
        links = np.unique(np.stack([fp[other], fp[group[other]]]), axis=1)
        for first in range(0, links.shape[1], 50_000):
            part = [pa.array(x[first : first + 50_000].view(np.int64)) for x in np.ascontiguousarray(links)]
            yield pa.RecordBatch.from_arrays(part, names=["a", "b"])

    parts = max(shuffle_partitions(spark), 1)
    return cells.repartition(parts, "cell").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, words: int = 4, radius: int = RADIUS, limit: int = CELL_POINTS) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Null and empty texts have fingerprint zero and link
    like any other; a null doc_id stays null in its row and gives no component its
    name (null if no row of the component has an id). Repeated rows come out again.
    Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, words).withColumnRenamed("id", "doc_id"), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(points.select("fp"), radius, limit))
    rooted = materialize(
        points.join(roots, points["fp"] == roots["node"], "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
