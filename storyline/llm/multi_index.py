"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are rotated by several learned rotations (each starts at random and is
turned until the signs lose least), and their signs make a code. Codes are split
into substrings, and every shard of rows has an index per substring. A row within
r bits of a query has at least one substring within floor(r / substrings) bits, so
probing the buckets in that distance meets every such row; those whose whole code
is within r are ranked by the inner product of the original vectors.

The radius belongs to the query: from its 20th best product with a bounded sample,
the angle to beat follows, and from that the bits it may differ in, with a margin
learned on the sample so that hardly any true neighbour is outside. A query that
finds too few rows is repeated with a radius that admits all rows.

Rows are sent to their shard once and queries stream past it. Shards are dealt by a
hash of the id, so any number of equal vectors is spread over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import parts_for
from storyline.session import materialize

BITS = 256
SUBSTRING = 16
#: Rows that the rotations, the margin and each query's radius are learned from.
SAMPLE_ROWS = 4096
SHARD_ROWS = 1 << 16
PAIR_BLOCK = 1 << 18
RECALL = 0.98
#: Differences of two substrings by their number of bits, and how many have at most so many.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUBSTRING)), kind="stable").astype(np.uint16)
NEIGHBOURS = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << SUBSTRING))))


@dataclass(frozen=True)
class Model:
    rotations: np.ndarray  # [dimension + 1, bits]
    scale: float  # largest norm
    sample_ids: np.ndarray
    sample: np.ndarray
    margin: float

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def codes(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        """Codes as rows of 16-bit substrings. Rows get one more component that makes all
        of one length, queries a zero there, so that the angle ranks as the product does."""
        scaled = vectors / (np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300) if as_query else self.scale)
        rest = np.zeros(len(vectors)) if as_query else np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        signs = np.column_stack([scaled, rest]) @ self.rotations > 0
        return np.packbits(signs, axis=1).view(np.uint16).reshape(len(vectors), -1)

    def expected(self, product: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of the bits in which a row of that product differs."""
        share = np.arccos(np.clip(product / np.maximum(norm * self.scale, 1e-300), -1, 1)) / np.pi
        return self.bits * share, np.sqrt(self.bits * share * (1 - share)) + 0.5

    def radius(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Bits within which each query looks; all of them if the sample says too little."""
        if len(self.sample) <= k:
            return np.full(len(queries), self.bits)
        products = queries @ self.sample.T
        products[ids[:, None] == self.sample_ids] = -np.inf
        to_beat = -np.partition(-products, k - 1, axis=1)[:, k - 1]
        mean, spread = self.expected(to_beat, np.linalg.norm(queries, axis=1))
        return np.minimum(self.bits, np.ceil(mean + self.margin * spread)).astype(np.int64)


def fit(ids: np.ndarray, vectors: np.ndarray, scale: float, k: int = 20, bits: int = BITS, seed: int = 7) -> Model:
    """Rotations and margin from sample vectors; ``scale`` is the largest norm of all rows."""
    rng = np.random.default_rng(seed)
    dimension = vectors.shape[1] + 1
    scaled = vectors / scale
    full = np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))])
    parts = []
    for _ in range(-(-bits // dimension)):
        turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        for _ in range(15):
            u, _, v = np.linalg.svd(np.sign(full @ turn).T @ full)
            turn = (u @ v).T
        parts.append(turn)
    rotations = np.column_stack(parts)[:, :bits]
    model = Model(rotations, scale, ids, vectors, 0.0)
    if len(vectors) <= k + 1:
        return model
    probe = rng.permutation(len(vectors))[:256]
    products = vectors[probe] @ vectors.T
    products[ids[probe][:, None] == ids] = -np.inf
    best = np.argsort(-products, axis=1)[:, :k]
    mean, spread = model.expected(np.take_along_axis(products, best, 1)[:, -1:], np.linalg.norm(vectors[probe], axis=1)[:, None])
    left, right = model.codes(vectors[probe], True), model.codes(vectors, False)
    differ = np.bitwise_count(left[:, None, :] ^ right[best]).sum(axis=2)
    return Model(rotations, scale, ids, vectors, float(np.quantile((differ - mean) / spread, RECALL)))


class SubstringIndex:
    """The codes of one shard, indexed by the value of each substring.

    ``touched`` counts the codes that probing met, before whole codes were compared.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self.touched = codes, 0
        self.wide = np.ascontiguousarray(codes.view(np.uint64).T)
        self.order, self.starts, self.values, self.place = [], [], [], []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            ends = np.cumsum(np.bincount(codes[:, j], minlength=1 << SUBSTRING))
            self.order.append(order)
            self.starts.append(np.concatenate([[0], ends]))
            values, place = np.unique(codes[:, j], return_inverse=True)
            self.values.append(values)
            self.place.append(place)

    def _look_up(self, j: int, value: int, distance: int) -> np.ndarray:
        """Rows whose substring ``j`` is one of the neighbours of ``value``, each looked up."""
        buckets = (value ^ MASKS[: NEIGHBOURS[distance]]).astype(np.int64)
        first = self.starts[j][buckets]
        size = self.starts[j][buckets + 1] - first
        some = size > 0
        first, size = first[some], size[some]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.order[j][np.repeat(first, size) + step]

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows whose whole code is within the radius of each query.

        With radius = a x substrings + b, such a row is within a bits of the query in one
        of the first b + 1 substrings or within a - 1 bits in one of the others. Where a
        value has more neighbours than the shard has buckets, the buckets are gone through.
        """
        parts = queries.shape[1]
        near, rest = np.divmod(np.asarray(radius, np.int64), parts)
        met = np.zeros((len(queries), len(self.codes)), bool)
        for j in range(parts):
            distance = np.minimum(np.where(j <= rest, near, near - 1), SUBSTRING)
            few = NEIGHBOURS[np.maximum(distance, 0)] <= len(self.values[j])
            for n in np.flatnonzero(few & (distance >= 0)):
                met[n, self._look_up(j, queries[n, j], distance[n])] = True
            many = np.flatnonzero(~few)
            if len(many):
                inside = np.bitwise_count(queries[many, j, None] ^ self.values[j]) <= distance[many, None].astype(np.uint8)
                inside = np.take(inside, self.place[j], axis=1)
                if len(many) == len(met):
                    met |= inside
                else:
                    met[many] |= inside
        touched = int(np.count_nonzero(met))
        self.touched += touched
        wide = queries.view(np.uint64)
        if 4 * touched > met.size:  # most are met: compared in place
            differ = np.zeros(met.shape, np.uint16)
            for w in range(wide.shape[1]):
                differ += np.bitwise_count(wide[:, w, None] ^ self.wide[w])
            return np.nonzero(met & (differ <= np.asarray(radius, np.uint16)[:, None]))
        query, row = np.nonzero(met)
        differ = np.zeros(len(row), np.uint16)
        for w in range(wide.shape[1]):
            differ += np.bitwise_count(wide[query, w] ^ self.wide[w, row])
        keep = differ <= np.asarray(radius)[query]
        return query[keep], row[keep]


def probe(codes: np.ndarray, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all codes within each query's radius, through the substring indexes."""
    return SubstringIndex(codes).within(queries, radius)


class Shard:
    """Vectors of one shard with their index, built once for all queries."""

    def __init__(self, model: Model, ids: np.ndarray, vectors: np.ndarray):
        self.model, self.ids, self.vectors = model, ids, vectors
        self.index = SubstringIndex(model.codes(vectors, False))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, everything: bool):
        """(query ids, row ids, products) of the best rows for every query."""
        model, found, step = self.model, [], max(1, PAIR_BLOCK // len(self.ids))
        radius = np.full(len(queries), model.bits) if everything else model.radius(query_ids, queries, k)
        codes = model.codes(queries, True)
        for first in range(0, len(queries), step):
            block = slice(first, first + step)
            query, row = self.index.within(codes[block], radius[block])
            ends = np.searchsorted(query, np.arange(len(codes[block]) + 1))
            for n, query_id in enumerate(query_ids[block]):
                rows = row[ends[n] : ends[n + 1]]
                rows = rows[self.ids[rows] != query_id]
                score = np.einsum("ij,j->i", self.vectors[rows], queries[first + n])
                if len(rows) > k:  # all that tie with the k-th stay until ids decide
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    rows, score = rows[score >= least], score[score >= least]
                order = np.lexsort((self.ids[rows], -score))[:k]
                found.append((np.full(len(order), query_id), self.ids[rows[order]], score[order]))
        return [np.concatenate(column) for column in zip(*found)]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vector: str = "embedding") -> Column:
    """The vector is there, not zero, and all its components are finite numbers."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _meet(rows: DataFrame, queries: DataFrame, model, n_rows: int, k: int, everything: bool) -> DataFrame:
    """Best ``k`` of each shard for every query. A row is sent once, a query once to every shard."""
    shards = parts_for(n_rows, SHARD_ROWS, 16)
    own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    left = rows.select(own.alias("shard"), F.lit(0).alias("asks"), "id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    # the rows of a shard come before its queries
    dealt = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "asks")

    def run(batches):
        number, held, shard = None, [], None
        for batch in batches:
            at, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.diff(at.astype(np.int64) * 2 + asks)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                part = batch.slice(a, b - a)
                if number is None or at[a] != number:
                    number, held, shard = at[a], [], None
                if not asks[a]:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if shard is None and held:
                    shard = Shard(model.value, *map(np.concatenate, zip(*held)))
                    held = []
                if shard is not None:
                    found = shard.best(part.column("id").to_numpy(), _matrix(part.column("v")), k, everything)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of largest inner product found.

    Products are in double precision on the vectors as they are; ties go to the
    smaller id. Rows with a null id, or a vector that is null, empty, zero, or holds null
    or non-finite components, take no part; a shorter vector counts as zero where it ends.
    Rows that share the query's id are its own. Other columns are not read. Every
    query gets ``k`` rows, or all there are.
    """
    spark = rows.sparkSession
    given = rows.where(usable(vector) & F.col(id_col).isNotNull())
    length = given.agg(F.max(F.size(vector))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if length is None:
        return empty
    x = F.col(vector).cast("array<double>")
    x = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(x)))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    stored = given.select(F.col(id_col).cast("long").alias("id"), x.alias("v"), is_query.alias("asks"))
    count, asked, scale = given.agg(F.count("*"), F.sum(is_query.cast("long")), F.max(norm)).first()
    if not asked:
        return empty
    # about twice the sample by hash, then cut to its bound
    chosen = stored.where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // (2 * SAMPLE_ROWS)))) == 0)
    sample = chosen.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE_ROWS).collect()
    model = fit(np.array([r.id for r in sample], np.int64), np.array([r.v for r in sample], float), float(scale), k)
    shared = spark.sparkContext.broadcast(model)  # SAMPLE_ROWS vectors
    queries, candidates = stored.where("asks").select("id", "v"), stored.select("id", "v")
    found = materialize(_meet(candidates, queries, shared, count, k, False), "found")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, count - 1))
    short = materialize(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"), "short-queries")
    again = short.count()
    if again:
        rest = _meet(candidates, short, shared, count, k, True)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
