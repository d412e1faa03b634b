"""Exact near-copy join over word sets.

Similarity of two texts is the cosine of their word-set vectors,
``|A & B| / sqrt(|A| * |B|)``. All tests are made on integers, so an edge never
depends on rounding.

How the join stays exact and small:

* texts with equal word sets are collapsed first and only the ``k + 1`` lowest
  ids of each group travel on, so a mass of identical copies costs one row;
* sets are banded by size; similar sets lie in one band or in neighbouring ones, and
  the size of a set bounds in how many words a similar one differs (at most D);
* the words of a set are dealt by hash to the parts of its band, more than D + 1. A word
  that differs touches one part, so of all parts at most D differ. A part's words are a
  signature, and only sets that share one are met. Parts have an order that depends on
  their words alone, rare words and many words first: above the first part that two
  similar sets share, each has at most D others, so the first D + 1 parts of a set are
  its signatures and parts of a frequent word or two are left out;
* of the sets that meet, some share a part by chance; a sketch of each set (for every
  bit, whether an odd number of its words have it) tells at least in how many words two
  sets differ, and rules these pairs out before any word is compared;
* a pair is met only where a stretch of shared parts begins, not once per part;
* signatures are made and shuffled in passes, by band and hash, and the sketches of the sets
  that share one travel with it: sets meet inside tasks, and only likely pairs leave them;
* likely pairs are dealt to blocks of sets that are near each other, so that the words of a set
  travel once per block and not once per pair, and a block gives the best ``k`` per row;
* signatures of more than ``posting_limit`` sets are cut into blocks. A block of few likely
  pairs gives these pairs, and only a block of a mass of near copies gets the words and
  returns the best ``k`` per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions.text import word_set
from storyline.operators.blocks import best_per_row, bounded_slices, entry_rows
from storyline.operators.skew import MAX_BROADCAST_ROWS, broadcast_if_small, hot_limit, join_hot, top_n_per_group
from storyline.session import BOUNDED_BATCHES, materialize, settings, shuffle_partitions

POSTING_LIMIT = 512
BLOCK_ROWS = 2048
VOCABULARY_SLICE = 4096
SKETCH_BITS = 256
#: A band reaches to this many times its first size, or as far as similar sets do.
BAND_WIDTH = 2
#: Parts for each that the largest set of a band needs, and some more for small sets.
PARTS = 1.3
SPARE_PARTS = 3
#: Sets whose words are counted, and words whose counts are used. They order the parts:
#: they steer the cost, never the result.
WEIGHT_SETS = 20_000
WEIGHT_WORDS = 1 << 16
#: Signatures of a pass and words that its blocks carry, at least, and shares of all of them at most.
PASS_SIGNATURES = 2_000_000
SIGNATURE_SHARES = 12
PASS_WORDS = 32_000_000
MOST_SHARES = 6
#: Bytes of a signature without its sketch, as it is shuffled.
SIGNATURE_BYTES = 64
#: Words of a block of sets whose pairs are compared together, and words that a set counts besides its own.
PAIR_BLOCK_WORDS = 1 << 19
SET_WORDS = 512
#: Rows of short lists that a task compares at a time, and pairs of them that it gives at a time.
MET_ROWS = 1 << 14
MET_PAIRS = 1 << 18
#: Bytes of blocks of pairs that a task gathers before it compares them, besides the last block.
MET_BYTES = 8 << 20
#: Likely pairs per row up to which a block of a long list gives pairs.
LIKELY_PER_ROW = 4


def term_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One stored row per text: id, digest of its word set, set size, sorted words."""
    sets = df.select(F.col(id_col).alias("id"), word_set(F.col(text_col)).alias("terms"))
    sets = sets.select("id", F.array_join("terms", " ").alias("words"), F.size("terms").cast("bigint").alias("n"))
    # words lie as one text, about half their size as a list
    stored = materialize(sets.select("id", F.sha2("words", 256).alias("key"), "n", "words"), "term-sets", "zstd")
    none = F.array().cast("array<string>")
    terms = F.when(F.col("n") > 0, F.split("words", " ")).when(F.col("words").isNotNull(), none)
    return stored.select("id", "key", "n", terms.alias("terms"))


def copy_groups(sets: DataFrame, k: int) -> DataFrame:
    """One row per distinct word set: lowest id, the k + 1 lowest ids, number of copies."""
    members = sets.where("n > 0").select("id", "key")
    firsts = (
        top_n_per_group(members, ["key"], [F.col("id")], k + 1)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    groups = firsts.join(sizes, "key").withColumn("gid", F.element_at("ids", 1))
    return materialize(groups.select("key", "gid", "ids", "copies"), "copy-groups")


def representatives(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, n, terms) of the sets that stand for their group, read where they lie.

    Words are not stored again: the ids that stay or those that go, whichever are
    fewer, are sent to the tasks. Only if both are many are the words moved and stored.
    """
    stay = groups.select(F.col("gid").alias("id"))
    named = sets.where("id is not null")
    go = materialize(named.select("id").join(stay, "id", "left_anti"), "copied-sets")
    if groups.count() <= go.count():
        listed, how = stay, "left_semi"
    else:
        listed, how = go, "left_anti"
    picked = lambda df: df.select(F.col("id").alias("gid"), "n", "terms")
    if listed.count() <= MAX_BROADCAST_ROWS:
        return picked(named.join(F.broadcast(listed), "id", how))
    # words move as one text, a third of their size as a list
    packed = named.select("id", "n", F.array_join("terms", " ").alias("words")).join(listed, "id", how)
    return picked(materialize(packed, "distinct-sets", "zstd").withColumn("terms", F.split("words", " ")))


def size_bands(longest: int, percent: int) -> list[int]:
    """First set size of each band; two similar sets lie in one band or in neighbouring ones."""

    def after(size: int) -> int:
        return max(BAND_WIDTH * size, size + 1, -(-size * 10_000 // (percent * percent)))

    bounds = [1]
    while bounds[-1] <= longest:
        bounds.append(after(bounds[-1]))
    return [*bounds, after(bounds[-1])]


def differing(largest: int, percent: int) -> int:
    """Words in which a set of ``largest`` words and a similar one of at most as many differ, at most."""
    return 2 * largest * (100 - percent) // 100


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def word_weights(reps: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and weights of the frequent words of a bounded part of the sets; weight of any other word.

    Weights are whole thousandths of the logarithm of one over a word's frequency, so that
    sums of them do not depend on their order.
    """
    total = reps.count()
    every = -(-total // WEIGHT_SETS) or 1
    counted = reps.where(F.pmod(F.xxhash64("gid"), F.lit(every)) == 0).select(F.explode("terms").alias("word"))
    counts = counted.groupBy(F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = np.array(counts.orderBy(F.desc("n"), "word").limit(WEIGHT_WORDS).collect(), np.int64).reshape(-1, 2)
    rows = rows[np.argsort(rows[:, 0].view(np.uint64) if len(rows) else rows[:, 0])] if len(rows) else rows
    weigh = lambda n: 1 + np.round(1000 * np.log(np.maximum(total / every / n, 1))).astype(np.int64)
    return np.ascontiguousarray(rows[:, 0]).view(np.uint64), weigh(rows[:, 1]), int(weigh(np.ones(1))[0])


def _part_signatures(
    rows: np.ndarray, words: np.ndarray, weights: np.ndarray, band: np.ndarray, parts: np.ndarray, most: np.ndarray
) -> tuple:
    """Signature, row and preceding signature of the first ``most`` parts of every row.

    ``parts`` and ``most`` are per row. The parts of a row are ordered by the weight of
    their words, then by signature; empty ones come last.
    """
    begin = np.concatenate(([0], np.cumsum(parts)))
    slot = begin[rows] + (_mixed(words ^ np.uint64(0x5851F42D4C957F2D)) % parts[rows].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(begin[-1], np.uint64)
    np.add.at(sums, slot, _mixed(words))
    # sums of whole numbers: the same in any order
    weight = np.bincount(slot, weights.astype(np.float64), begin[-1])
    owner = np.repeat(np.arange(len(parts)), parts)
    place = np.arange(begin[-1])
    key = _mixed(sums + (place - begin[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + band[owner].astype(np.uint64)
    key = _mixed(key)
    order = np.lexsort((key, -weight, owner))
    used = np.sort(order[place - begin[owner] < most[owner]])
    key, owner = key[used], owner[used]
    prior = np.concatenate((np.zeros(1, np.uint64), key[:-1]))[: len(key)]
    prior[1:][owner[1:] != owner[:-1]] = 0
    return key, owner, prior


def _band_bounds(reps: DataFrame, percent: int) -> np.ndarray:
    return np.array(size_bands(reps.agg(F.max("n")).first()[0] or 1, percent))


def _visits(n: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple]:
    """(band, home, wanted, signatures) of sets of ``n`` words, in their own band and the next larger one."""
    own = np.searchsorted(bounds, n, "right") - 1
    largest = n * 10_000 // (percent * percent)
    visits = []
    for band, home in ((own, True), (own + 1, False)):
        differ = differing(np.minimum(largest, bounds[band + 1] - 1), percent)
        # sets that differ in no word are one set
        visits.append((band, home, (differ > 0) & (largest >= bounds[band]), differ + 1))
    return visits


def signature_passes(reps: DataFrame, percent: int, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first band, last band, slice, slices) of passes that shuffle about as much each.

    Together they make every signature once. A signature counts by its bytes with the sketch that
    may travel with it. The number of passes is bounded, so is how often a set is read.
    """
    # one row per size of a set
    sizes = np.array(reps.groupBy("n").count().collect(), np.int64).reshape(-1, 2)
    counts = np.zeros(len(bounds), np.int64)
    weight = (SIGNATURE_BYTES + _sketch_bits(sizes[:, 0]) // 8) // (SIGNATURE_BYTES + SKETCH_BITS // 8)
    for band, _, wanted, signatures in _visits(sizes[:, 0], bounds, percent):
        np.add.at(counts, band[wanted], (signatures * sizes[:, 1] * weight)[wanted])
    share = max(PASS_SIGNATURES, -(-int(counts.sum()) // SIGNATURE_SHARES))
    passes, first, held = [], 0, 0
    for band, count in enumerate(counts.tolist()):
        if held and held + count > share:
            passes.append((first, band - 1, 0, 1))
            first, held = band, 0
        if count > share:
            slices = -(-count // share)
            passes += [(band, band, part, slices) for part in range(slices)]
            first = band + 1
        else:
            held += count
    return [*passes, (first, len(bounds) - 1, 0, 1)] if held else passes


def _signatures(
    reps: DataFrame, percent: int, bounds: np.ndarray | None = None, weights: tuple | None = None,
    part: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """(key, gid, n, home, prior): what sets have to share, in their own band and the next
    larger one, if a similar set may lie there.

    ``home`` marks the own band, ``prior`` is the signature of the part before, of those used.
    ``part`` is one of :func:`signature_passes`.
    """
    bounds = _band_bounds(reps, percent) if bounds is None else bounds
    first, last, number_of, slices = part or (0, len(bounds), 0, 1)
    parts_of = np.array([int(PARTS * (differing(int(after) - 1, percent) + 1)) + SPARE_PARTS for after in bounds[1:]])
    known, weight, rare = weights or word_weights(reps)

    def sign(batches):
        for batch in bounded_slices(batches, "hashes"):
            lists = batch.column("hashes")
            rows = entry_rows(lists)
            words = lists.flatten().to_numpy().view(np.uint64)
            weights = np.full(len(words), rare)
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                weights = np.where(known[at] == words, weight[at], rare)
            n = batch.column("n").to_numpy()
            for band, home, wanted, most in _visits(n, bounds, percent):
                wanted = wanted & (band >= first) & (band <= last)
                number = np.cumsum(wanted) - 1
                take = wanted[rows]
                picked = np.flatnonzero(wanted)
                key, owner, prior = _part_signatures(
                    number[rows[take]], words[take], weights[take], band[picked], parts_of[band[picked]], most[picked]
                )
                owner = picked[owner]
                if slices > 1:
                    mine = key % np.uint64(slices) == number_of
                    key, owner, prior = key[mine], owner[mine], prior[mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), batch.column("gid").take(pa.array(owner)), pa.array(n[owner]),
                        pa.array(np.full(len(owner), home)), pa.array(prior.view(np.int64)),
                    ],
                    names=["key", "gid", "n", "home", "prior"],
                )

    if part:
        # sets of these bands, and those of the band before that a similar set here may be of
        reps = reps.where((F.col("n") < int(bounds[min(last + 1, len(bounds) - 1)])) & (F.col("n") >= int(bounds[first]) * percent * percent // 10_000))
    hashed = reps.select("gid", "n", F.transform("terms", lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.mapInArrow(sign, "key long, gid long, n long, home boolean, prior long")


def _reaches(overlap: str, n_a: str, n_b: str, percent: int) -> str:
    """SQL text of: overlap / sqrt(n_a * n_b) >= percent / 100, in integers."""
    return f"10000 * {overlap} * {overlap} >= {percent * percent} * {n_a} * {n_b}"


def _sketch_bits(n: np.ndarray) -> np.ndarray:
    return SKETCH_BITS << np.maximum(np.floor(np.log2(np.maximum(n, 1) / SKETCH_BITS)), 0).astype(np.int64)


def set_sketches(reps: DataFrame) -> DataFrame:
    """(gid, sketch): per bit, the parity of the words that have it.

    A sketch has half as many bits as its set has words or more, :data:`SKETCH_BITS` at least and
    that many times a power of two, so that unlike sets differ in more bits than similar ones may.
    """

    def sketch(batches):
        for batch in bounded_slices(batches, "hashes"):
            lists = batch.column("hashes")
            rows = entry_rows(lists)
            bits = _sketch_bits(np.bincount(rows, minlength=batch.num_rows))
            begin = np.concatenate(([0], np.cumsum(bits)))
            bit = _mixed(lists.flatten().to_numpy().view(np.uint64)) % bits[rows].astype(np.uint64)
            counts = np.bincount(begin[rows] + bit.astype(np.int64), minlength=begin[-1])
            packed = np.packbits((counts % 2).astype(np.uint8)).view(np.int64)
            ends = pa.array((begin // 64).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.ListArray.from_arrays(ends, pa.array(packed))], names=["gid", "sketch"])

    hashed = reps.select("gid", F.transform("terms", lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.mapInArrow(sketch, "gid long, sketch array<long>")


def _folded(sketch: Column, other: Column) -> Column:
    """The sketch at half its length, if the other one is shorter: what a sketch of that length would hold."""
    half = (F.size(sketch) / 2).cast("int")
    parts = F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half)
    return F.when(F.size(sketch) > F.size(other), F.zip_with(*parts, lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)


def likely_pairs(candidates: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Candidates that the sketches do not rule out: words differ in at least as many as bits do.

    For pairs that are given; the join itself meets sets inside tasks (:func:`met_lists`).
    """
    left = sketches.select(F.col("gid").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("gid").alias("b"), F.col("sketch").alias("sb"))
    pair = _folded(F.col("sa"), F.col("sb")), _folded(F.col("sb"), F.col("sa"))
    same = F.zip_with(*pair, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # lengths that are farther apart (at low thresholds) tell nothing
    bits = F.coalesce(F.aggregate(same, F.lit(0), lambda total, n: total + n), F.lit(0))
    met = candidates.join(left, "a").join(right, "b").withColumn("_differ", bits)
    met = met.withColumn("most", F.expr("(na + nb - _differ) div 2"))
    return met.where(_reaches("most", "na", "nb", percent)).select("a", "b", "na", "nb")


def candidate_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the sets that share a signature, each pair once, ``a`` at home in its band.

    Tests compare :func:`met_lists` with it.
    """
    a = short.where("home").select("key", F.col("gid").alias("a"), F.col("n").alias("na"), F.col("prior").alias("pa"))
    b = short.select("key", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("prior").alias("pb"), F.col("home").alias("hb"))
    return (
        a.join(b, "key")
        .where("pa != pb or pa = 0")
        .where("a != b and (not hb or a < b)")
        .where(f"10000 * least(na, nb) >= {percent * percent} * greatest(na, nb)")
        .select("a", "b", "na", "nb")
        # one shuffle serves both the distinct and the first join
        .repartition(shuffle_partitions(short.sparkSession), "a")
        .distinct()
    )


def _folded_rows(sketches: pa.ListArray, size: int) -> np.ndarray:
    """The sketches of at least ``size`` words, folded to that many; the rows of shorter ones are zero."""
    starts, lengths = sketches.offsets.to_numpy()[:-1], np.diff(sketches.offsets.to_numpy())
    words = sketches.values.to_numpy().view(np.uint64)
    folded = np.zeros((len(sketches), size), np.uint64)
    for length in np.unique(lengths[lengths >= size]):
        rows = np.flatnonzero(lengths == length)
        taken = words[starts[rows][:, None] + np.arange(length)]
        folded[rows] = np.bitwise_xor.reduce(taken.reshape(len(rows), length // size, size), axis=1)
    return folded


def _meet(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the likely pairs within the lists of one key each; rows of a key lie together."""
    key, gid, n, prior = (table[c].to_numpy() for c in ("key", "gid", "n", "prior"))
    home = table["home"].to_numpy()
    sketches = table["sketch"].combine_chunks()
    length = np.diff(sketches.offsets.to_numpy())
    begin = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    end = np.repeat(begin[1:], np.diff(begin))
    folded: dict = {}
    found: list = []
    left, step = np.arange(len(key)), 0
    # rows meet the next one of their list, then the one behind it, and so on
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        right = left + step
        met = (home[left] | home[right]) & (gid[left] != gid[right]) & ((prior[left] != prior[right]) | (prior[left] == 0))
        met &= 10_000 * np.minimum(n[left], n[right]) >= percent * percent * np.maximum(n[left], n[right])
        a, b = left[met], right[met]
        shorter = np.minimum(length[a], length[b])
        for size in np.unique(shorter).tolist():
            if size not in folded:
                folded[size] = _folded_rows(sketches, size)
            x, y = (rows[shorter == size] for rows in (a, b))
            bits = np.bitwise_count(folded[size][x] ^ folded[size][y]).sum(axis=1).astype(np.int64)
            most = np.minimum((n[x] + n[y] - bits) // 2, np.minimum(n[x], n[y]))
            likely = (most > 0) & (10_000 * most * most >= percent * percent * n[x] * n[y])
            found.append((x[likely], y[likely]))
        if found and (not len(left) or sum(len(x) for x, _ in found) > MET_PAIRS):
            yield tuple(np.concatenate(rows) for rows in zip(*found))
            found = []


def met_lists(shared: DataFrame, sketches: DataFrame, percent: int, posting_limit: int) -> DataFrame:
    """(key, gid, n, home, prior, rows, other, n_other): likely pairs of sets that share a signature.

    ``shared`` has the rows of signatures and in ``rows`` how many a signature has. Lists of more than
    ``posting_limit`` rows are not compared: their rows come without ``other``.
    """
    kinds = {"key": "long", "gid": "long", "n": "long", "home": "boolean", "prior": "long", "rows": "long"}

    def meet(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            long = np.asarray(rows["rows"].to_numpy()) > posting_limit
            if long.any():
                listed = rows.filter(pa.array(long)).select(list(kinds))
                none = pa.nulls(listed.num_rows, pa.int64())
                yield from listed.append_column("other", none).append_column("n_other", none).combine_chunks().to_batches()
                rows = rows.filter(pa.array(~long))
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < MET_ROWS:
                continue
            # the last list may go on in the next batch
            key = held["key"].to_numpy()
            whole = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            yield from pairs(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from pairs(held)

    def pairs(table):
        table = table.combine_chunks()
        for a, b in _meet(table, percent) if table.num_rows > 1 else ():
            other = table.select(["gid", "n"]).take(pa.array(b))
            found = table.select(list(kinds)).take(pa.array(a)).append_column("other", other["gid"]).append_column("n_other", other["n"])
            yield from found.combine_chunks().to_batches()

    # a long list goes to many tasks
    salt = F.when(F.col("rows") > posting_limit, F.pmod(F.xxhash64("gid"), F.ceil(F.col("rows") / posting_limit))).otherwise(0)
    dealt = shared.join(sketches, "gid").repartition("key", salt).sortWithinPartitions("key")
    return dealt.mapInArrow(meet, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", other long, n_other long")


def _all_met(reps: DataFrame, sketches: DataFrame, percent: int, posting_limit: int) -> DataFrame:
    """:func:`met_lists` of all signatures, one pass stored after the other."""
    bounds = _band_bounds(reps, percent)
    weights = word_weights(reps)
    # nothing can be met without signatures, which still gives a table
    passes = signature_passes(reps, percent, bounds) or [(0, len(bounds) - 1, 0, 1)]
    with settings(reps.sparkSession, BOUNDED_BATCHES):
        stored = [
            materialize(met_lists(shared_signatures(_signatures(reps, percent, bounds, weights, part)), sketches, percent, posting_limit), "met-lists")
            for part in passes
        ]
    return reduce(DataFrame.unionByName, stored)


def pair_blocks(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``candidates`` with the ``key`` of the block they are compared in, and the (key, gid, n) of its sets.

    A pair lies in the cell of a small set near its ``a``, so that the pairs of a family of near
    copies lie together. A cell is cut by hash into blocks of bounded size, which meet in pairs.
    """
    near = candidates.groupBy(F.col("b").alias("gid")).agg(F.min("a").alias("near"))
    near = broadcast_if_small(materialize(near, "near-sets"))
    placed = candidates.withColumn("cell", F.col("a"))
    for _ in range(2):
        step = near.select(F.col("gid").alias("cell"), F.col("near").alias("_near"))
        placed = placed.join(step, "cell", "left").withColumn("cell", F.coalesce("_near", "cell")).drop("_near")
    placed = materialize(placed, "placed-pairs")
    sides = F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("na").alias("n")), F.struct(F.col("b").alias("gid"), F.col("nb").alias("n"))))
    members = placed.select("cell", sides.alias("s")).select("cell", "s.gid", "s.n").distinct()
    blocks = members.groupBy("cell").agg(F.ceil(F.sum(F.col("n") + SET_WORDS) / F.lit(PAIR_BLOCK_WORDS)).alias("blocks"))
    # most cells are one block
    cut = broadcast_if_small(materialize(blocks.where("blocks > 1"), "cut-cells"))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    pairs = placed.join(cut, "cell", "left").withColumn("key", F.xxhash64("cell", part("a"), part("b"))).drop("cell", "blocks")
    return pairs, pairs.select("key", sides.alias("s")).groupBy("key", "s.gid").agg(F.max("s.n").alias("n"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole keys, which lie together, some bounded number of them at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.num_rows < MET_ROWS and held.nbytes < MET_BYTES:
            continue
        # the last block may go on in the next batch
        key = held["key"].to_numpy()
        whole = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if whole:
            yield held.slice(0, whole)
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield held


def _best_of_blocks(table: pa.Table, k: int, percent: int) -> pa.RecordBatch:
    """Best ``k`` partners per set of each block: rows with words are its sets, rows with ``other`` its pairs.

    An id may have several rows with words; a pair is compared in all of them, and what is found comes
    as often as they do, at most ``k`` times.
    """
    is_pair = pc.is_valid(table["other"])
    sets, pairs = (table.filter(rows).combine_chunks() for rows in (pc.invert(is_pair), is_pair))
    _, named = np.unique(np.concatenate([sets["gid"], pairs["gid"], pairs["other"]]), return_inverse=True)
    _, block = np.unique(np.concatenate([sets["key"], pairs["key"], pairs["key"]]), return_inverse=True)
    place = block.astype(np.int64) * (len(named) + 1) + named
    texts = sets["words"].combine_chunks().dictionary_encode()
    text = texts.indices.to_numpy()
    version, copies = np.unique(place[: len(sets)] * (len(text) + 1) + text, return_counts=True)
    text, holder = version % (len(text) + 1), version // (len(text) + 1)
    low, high = (np.searchsorted(holder, place[len(sets) :], side) for side in ("left", "right"))
    low_a, low_b, of_a, of_b = low[: len(pairs)], low[len(pairs) :], *np.split(high - low, 2)
    pair = np.repeat(np.arange(len(pairs)), of_a * of_b)
    turn = np.arange(len(pair)) - np.repeat(np.cumsum(of_a * of_b) - of_a * of_b, of_a * of_b)
    a, b = low_a[pair] + turn // of_b[pair], low_b[pair] + turn % of_b[pair]
    by_a = np.argsort(a, kind="stable")
    a, b, pair = a[by_a], b[by_a], pair[by_a]

    lists = pc.split_pattern(texts.dictionary, " ")
    encoded = lists.flatten().dictionary_encode()
    codes, ends = encoded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    begin, size = ends[:-1][text], np.diff(ends)[text]
    wanted = np.zeros(len(encoded.dictionary), bool)
    o = np.zeros(len(a), np.int64)
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    for first, last in zip(starts, [*starts[1:], len(a)]):
        mine = codes[begin[a[first]] : begin[a[first]] + size[a[first]]]
        wanted[mine] = True
        length = size[b[first:last]]
        at = np.cumsum(length) - length
        entries = np.arange(length.sum()) + np.repeat(begin[b[first:last]] - at, length)
        o[first:last] = np.add.reduceat(wanted[codes[entries]], at, dtype=np.int64)
        wanted[mine] = False

    n_a, n_b = pairs["n"].to_numpy()[pair], pairs["n_other"].to_numpy()[pair]
    near = 10_000 * o * o >= percent * percent * n_a * n_b
    often = np.minimum(copies[a] * copies[b], k)[near]
    o, n_a, n_b, pair = o[near], n_a[near], n_b[near], pair[near]
    ids = pairs["gid"].to_numpy()[pair], pairs["other"].to_numpy()[pair]
    src, dst, n_dst = np.concatenate(ids), np.concatenate(ids[::-1]), np.concatenate([n_b, n_a])
    o, often = np.concatenate([o, o]), np.concatenate([often, often])
    order = np.lexsort((dst, -(o.astype(np.float64) * o / n_dst), src))
    src, dst = src[order], dst[order]
    # partners count once, however often they come
    _, first = np.unique(np.stack([src, dst]), axis=1, return_index=True)
    seen = np.cumsum(np.bincount(first, minlength=len(src)))
    before = np.append(0, seen)[np.searchsorted(src, src)]
    best = np.repeat(np.flatnonzero(seen - before <= k), often[order][seen - before <= k])
    out = src[best], dst[best], o[order][best], n_dst[order][best]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["src", "dst", "o", "n_dst"])


def _stored_pairs(candidates: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst, o, n_dst): the best ``k`` partners of each set in each block of pairs, in passes by block."""
    named = candidates.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
    # only sets that are in a pair are moved, their words as one text
    named = broadcast_if_small(materialize(named, "paired-sets"))
    words = reps.join(named, "gid", "left_semi").select("gid", F.array_join("terms", " ").alias("words"))
    words = materialize(words, "paired-words", "zstd")
    pairs, members = pair_blocks(candidates)
    members = materialize(members, "block-sets")
    carried = members.agg(F.sum("n")).first()[0] or 0
    passes = min(MOST_SHARES, -(-carried // PASS_WORDS)) or 1

    def compare(batches):
        for table in _whole_blocks(batches):
            yield _best_of_blocks(table, k, percent)

    stored = []
    with settings(reps.sparkSession, BOUNDED_BATCHES):
        for number in range(passes):
            mine = F.pmod("key", F.lit(passes)) == number
            sets = members.where(mine).join(words, "gid").select("key", "gid", "words")
            met = pairs.where(mine).select("key", F.col("a").alias("gid"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("n_other"))
            dealt = sets.unionByName(met, allowMissingColumns=True).repartition("key").sortWithinPartitions("key")
            stored.append(materialize(dealt.mapInArrow(compare, "src long, dst long, o long, n_dst long"), "verified-pairs"))
    return reduce(DataFrame.unionByName, stored)


def _incidence(lists: pa.ChunkedArray, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Row and word number of every entry of a list column."""
    array = lists.combine_chunks()
    rows = entry_rows(array)
    encoded = array.flatten().dictionary_encode()
    known = encoded.dictionary.to_pylist()
    mapping = np.array([codes.setdefault(w, len(codes)) for w in known], dtype=np.int64)
    if len(rows) == 0:
        return rows, rows
    return rows, mapping[encoded.indices.to_numpy()]


def _shared_words(a, b, shape: tuple[int, int], vocabulary: int, same: bool) -> np.ndarray:
    """Number of shared words of every pair of different rows, by matrix products.

    Only words that occur on both sides (in two rows, when a block meets itself)
    can be shared, so only those get a column.
    """
    in_a, in_b = (np.bincount(cols, minlength=vocabulary) for _, cols in (a, b))
    useful = in_a > 1 if same else (in_a > 0) & (in_b > 0)
    column = np.cumsum(useful) - 1
    sides = [(rows[useful[cols]], column[cols[useful[cols]]]) for rows, cols in (a, b)]
    shared = np.zeros(shape, dtype=np.float32)
    for start in range(0, int(useful.sum()), VOCABULARY_SLICE):
        width = min(VOCABULARY_SLICE, int(useful.sum()) - start)
        parts = []
        for (rows, cols), height in zip(sides, shape):
            inside = (cols >= start) & (cols < start + width)
            matrix = np.zeros((height, width), dtype=np.float32)
            matrix[rows[inside], cols[inside] - start] = 1.0
            parts.append(matrix)
        shared += parts[0] @ parts[1].T
    return shared


def _block_kernel(k: int, percent: int):
    """Best ``k`` partners per row of one pair of blocks of one signature's list."""
    out_schema = pa.schema(
        [("src", pa.int64()), ("dst", pa.int64()), ("o", pa.int64()), ("n_dst", pa.int64())]
    )

    def best(ids_a, ids_b, n_b, shared, allowed):
        score = shared.astype(np.float64) ** 2 / n_b[None, :]
        rows, cols = best_per_row(score, ids_b, k, allowed)
        o = shared[rows, cols].astype(np.int64)
        return pa.table([ids_a[rows], ids_b[cols], o, n_b[cols]], schema=out_schema)

    def kernel(table: pa.Table) -> pa.Table:
        first, second = table["a"][0].as_py(), table["b"][0].as_py()
        block = table["block"].to_numpy()
        parts = [table.filter(pa.array(block == number)) for number in (first, second)]
        (ids_a, n_a), (ids_b, n_b) = [(p["gid"].to_numpy(), p["n"].to_numpy()) for p in parts]
        shape = (len(ids_a), len(ids_b))
        if 0 in shape:
            return out_schema.empty_table()
        priors = [p["prior"].to_numpy() for p in parts]
        homes = [p["home"].to_numpy(zero_copy_only=False) for p in parts]
        allowed = _met(priors, homes, [ids_a, ids_b])
        if not allowed.any():
            return out_schema.empty_table()
        codes: dict = {}
        terms = [_incidence(p["terms"], codes) for p in parts]
        shared = _shared_words(*terms, shape, len(codes), first == second)
        o = shared.astype(np.int64)
        allowed &= 10_000 * o * o >= percent * percent * np.outer(n_a, n_b)
        result = best(ids_a, ids_b, n_b, shared, allowed)
        if first != second:
            other = best(ids_b, ids_a, n_a, shared.T, allowed.T)
            result = pa.concat_tables([result, other])
        return result

    return kernel


def _met(priors: list, homes: list, ids: list) -> np.ndarray:
    """Which pairs of two blocks belong to this list: a stretch of shared parts begins here."""
    met = (priors[0][:, None] != priors[1][None, :]) | (priors[0][:, None] == 0)
    met &= homes[0][:, None] | homes[1][None, :]
    return met & (ids[0][:, None] != ids[1][None, :])


def _signs(sketches: pa.ListArray, size: int) -> np.ndarray:
    """The bits of every sketch, folded to ``size`` words, as 1 and -1."""
    rows = entry_rows(sketches)
    place = np.arange(len(rows)) - (sketches.offsets.to_numpy()[:-1] - sketches.offsets.to_numpy()[0])[rows]
    folded = np.zeros((len(sketches), size), np.uint64)
    np.bitwise_xor.at(folded, (rows, place % size), sketches.flatten().to_numpy().view(np.uint64))
    return 1 - 2 * np.unpackbits(folded.view(np.uint8), axis=1).astype(np.float32)


def _likely_kernel(percent: int):
    """Likely pairs of one pair of blocks of one signature's list, by their sketches.

    A block of more than :data:`LIKELY_PER_ROW` of them per row gives one row without ids.
    """
    out_schema = pa.schema([(c, pa.int64()) for c in ("key", "first", "second", "src", "dst", "n_src", "n_dst")])

    def kernel(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place = [table[c][0].as_py() for c in ("key", "a", "b")]
        block = table["block"].to_numpy()
        parts = [table.filter(pa.array(block == number)) for number in place[1:]]
        ids, n, priors = [[p[c].to_numpy() for p in parts] for c in ("gid", "n", "prior")]
        homes = [p["home"].to_numpy() for p in parts]
        if 0 in (len(ids[0]), len(ids[1])):
            return out_schema.empty_table()
        size = min(int(np.diff(p["sketch"].combine_chunks().offsets.to_numpy()).min()) for p in parts)
        signs = [_signs(p["sketch"].combine_chunks(), size) for p in parts]
        bits = (64 * size - signs[0] @ signs[1].T) / 2
        total = n[0][:, None] + n[1][None, :]
        most = np.minimum((total - bits) // 2, np.minimum(n[0][:, None], n[1][None, :])).astype(np.int64)
        likely = (most > 0) & (10_000 * most * most >= percent * percent * n[0][:, None] * n[1][None, :])
        likely &= _met(priors, homes, ids)
        if place[1] == place[2]:
            likely &= ids[0][:, None] < ids[1][None, :]
        rows, cols = np.nonzero(likely)
        if len(rows) > LIKELY_PER_ROW * max(likely.shape):
            return pa.table([*([x] for x in place), *([None] for _ in range(4))], schema=out_schema)
        found = [ids[0][rows], ids[1][cols], n[0][rows], n[1][cols]]
        return pa.table([*(np.full(len(rows), x) for x in place), *found], schema=out_schema)

    return kernel


def _long_lists(long: DataFrame, sketches: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Likely pairs from signatures of very many sets, and the blocks that have too many of them."""
    dealt = _paired_blocks(long, block_rows).join(sketches, "gid")
    likely = dealt.groupBy("key", "a", "b").applyInArrow(
        _likely_kernel(percent), "key long, first long, second long, src long, dst long, n_src long, n_dst long"
    )
    return materialize(likely, "long-lists")


def _paired_blocks(long: DataFrame, block_rows: int) -> DataFrame:
    """Every row of a long list with each block of its list: ``a`` <= ``b`` are the blocks that meet."""
    blocks = F.ceil(F.col("rows") / F.lit(block_rows)).cast("int")
    placed = long.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
    )
    return placed.select(
        "key", "gid", "n", "home", "prior", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})


def _crowded_pairs(long: DataFrame, crowded: DataFrame, reps: DataFrame, k: int, percent: int, block_rows: int) -> DataFrame:
    """Best partners within the blocks of long lists that hold a mass of near copies."""
    wanted = broadcast_if_small(crowded.select("key", F.col("first").alias("a"), F.col("second").alias("b")))
    paired = _paired_blocks(long, block_rows).join(wanted, ["key", "a", "b"], "left_semi")
    # only sets of such blocks are moved
    named = broadcast_if_small(materialize(paired.select("gid").distinct(), "crowded-sets"))
    words = reps.select("gid", "terms").join(named, "gid", "left_semi")
    return paired.join(words, "gid").groupBy("key", "a", "b").applyInArrow(
        _block_kernel(k, percent), "src long, dst long, o long, n_dst long"
    )


def shared_lists(signatures: DataFrame) -> DataFrame:
    """(key, rows) of the signatures that several sets have, one of them at home."""
    counts = signatures.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("_home"))
    return materialize(counts.where("rows > 1 and _home").select("key", "rows"), "signature-lists")


def shared_signatures(signatures: DataFrame) -> DataFrame:
    """The rows of :func:`shared_lists`, with ``rows``; signatures move once."""
    same = Window.partitionBy("key")
    counted = signatures.withColumns({"rows": F.count(F.lit(1)).over(same), "_home": F.max("home").over(same)})
    return counted.where("rows > 1 and _home").drop("_home")


def neighbour_edges(
    sets: DataFrame,
    k: int = C.NEIGHBOURS,
    percent: int = C.SIMILARITY_PERCENT,
    posting_limit: int = POSTING_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` best other texts of each text among those that reach the threshold.

    ``sets`` is the output of :func:`term_sets`. Neighbours are ordered by
    similarity, then id. Columns: src, dst, pos (1-based), overlap, n_src, n_dst.
    """
    groups = copy_groups(sets, k)
    reps = representatives(sets, groups)
    sketches = materialize(set_sketches(reps), "set-sketches")
    met = _all_met(reps, sketches, percent, posting_limit)
    pairs = met.where("other is not null")
    likely = pairs.select(F.col("gid").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("n_other").alias("nb"))
    long = met.where("other is null").drop("other", "n_other")
    crowded = None
    if not long.isEmpty():
        listed = _long_lists(long, sketches, percent, block_rows)
        named = [F.col(old).alias(new) for old, new in (("src", "a"), ("dst", "b"), ("n_src", "na"), ("n_dst", "nb"))]
        likely = likely.unionByName(listed.where("src is not null").select(*named))
        crowded = listed.where("src is null")
    pair = F.least("a", "b"), F.greatest("a", "b")
    likely = likely.select(
        pair[0].alias("a"), pair[1].alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
        F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"),
    ).distinct()
    pairs = _stored_pairs(materialize(likely, "likely-pairs"), reps, k, percent)
    if crowded is not None and not crowded.isEmpty():
        from_crowded = materialize(_crowded_pairs(long, crowded, reps, k, percent, block_rows), "crowded-pairs")
        pairs = pairs.unionByName(from_crowded).dropDuplicates(["src", "dst"])

    by_similarity = F.desc(F.col("o").cast("double") * F.col("o") / F.col("n_dst"))
    near = top_n_per_group(pairs, ["src"], [by_similarity, F.col("dst")], k)

    # group level: own copies and the lowest ids of the near groups
    other = near.join(groups.select(F.col("gid").alias("dst"), "ids"), "dst").select(
        F.col("src").alias("gid"), "o", "n_dst", F.explode("ids").alias("id")
    )
    sizes = reps.select("gid", F.col("n").alias("n_dst"))
    own = groups.where("copies > 1").join(sizes, "gid").select(
        "gid", F.col("n_dst").alias("o"), "n_dst", F.explode("ids").alias("id")
    )
    listed = top_n_per_group(own.unionByName(other), ["gid"], [by_similarity, F.col("id")], k + 1)
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(by_similarity, "id"))
    listed = (
        listed.withColumn("r", rank)
        .groupBy("gid")
        .agg(F.array_sort(F.collect_list(F.struct("r", "id", "o", "n_dst"))).alias("near"))
    )
    listed = listed.join(groups.select("gid", "key", "copies"), "gid").drop("gid")

    members = sets.where("n > 0").select("id", "key", "n")
    joined = join_hot(members, listed, ["key"], "copies", hot_limit(members.count()))
    mine = F.filter("near", lambda e: e["id"] != F.col("id"))
    return joined.select(
        F.col("id").alias("src"), F.col("n").alias("n_src"),
        F.posexplode(F.slice(mine, 1, k)).alias("p", "e"),
    ).select(
        "src", F.col("e.id").alias("dst"), (F.col("p") + 1).cast("bigint").alias("pos"),
        F.col("e.o").alias("overlap"), "n_src", F.col("e.n_dst").alias("n_dst"),
    )
