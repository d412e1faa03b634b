"""Exact k-nearest-neighbour join of dense vectors by inner product of unit vectors.

Vectors are sorted into a tree of pivots: a cell of more rows than a block is divided
among a few pivots of its own, chosen by hash, until cells are of bounded size. A node
knows its pivot and the largest angle of its rows to it, a ball that holds them all.
Cells that lie side by side in the tree form groups of bounded size. In a first pass the
rows of each group meet, which gives every row a lower bound for its k-th similarity; then
every cell walks down the tree, and a node is passed over if the angle between the pivots,
less both radii, cannot beat the bound of any row of the two. Skipped work is therefore never
needed, and what is not skipped is exact (``meeting``). Two groups with cells to visit meet
in one task, where each pair of rows is multiplied once and offered both ways, and a cell is
sent to a group once, however many cells of it it visits; a task returns only the best ``k``
per row. Tree, bounds and walk are tables; nothing of them is gathered on the driver. Identical vectors are
collapsed first, so a mass of copies costs one row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions.vectors import inner_product, l2_norm
from storyline.operators.blocks import entry_rows, matrix
from storyline.operators.meeting import Side, meet, side
from storyline.operators.skew import hot_limit, join_hot, running_total, top_n_per_group
from storyline.session import BOUNDED_BATCHES, materialize, settings

BLOCK_ROWS = 1024
BLOCK_VALUES = 1_000_000
#: Rows and numbers of a group of cells that meets another one in a task, about.
GROUP_ROWS = 65_536
GROUP_VALUES = 1 << 22
#: Bytes that are moved for a round of such pairs, or copies of all rows if that is more.
ROUND_BYTES, ROUND_COPIES = 1 << 29, 4
#: Cells of a bucket and nodes of a level that meet in a task of the walk.
WALK_CELLS, WALK_NODES = 512, 2048
#: Pivots that divide a cell, and levels of the tree; a cell that is too large at the last
#: level is cut into blocks.
FAN = 16
MAX_DEPTH = 12
ANGLE_SLACK = 1e-6
_KTH = "array<struct<gid: bigint, kth: double>>"


class Tree(NamedTuple):
    """``placed``: gid, vec, cell (a leaf) of every row. ``nodes``: node, parent, pivot, radius, leaf, level."""

    placed: DataFrame
    nodes: DataFrame | None
    depth: int


def _angle(similarity: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarity, -1.0, 1.0))


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, normalize: bool = True) -> DataFrame:
    """(id, vec DOUBLE array); rows without a vector or with a zero vector are left out."""
    vec = F.col(vector_col)
    rows = df.where(vec.isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vec, lambda x: x.cast("double")).alias("vec"),
    )
    if not normalize:
        return rows
    rows = rows.withColumn("_norm", l2_norm(F.col("vec"))).where("_norm > 0")
    # an array of the norm: inside a lambda over the numbers it would be computed for each of them
    norms = F.array_repeat("_norm", F.size("vec"))
    return rows.select("id", F.zip_with("vec", norms, lambda x, norm: x / norm).alias("vec"))


def _assign():
    """Child and angle of the rows of one part of a cell, by the cell's pivots."""

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        names = ["gid", "vec", "node", "angle"]
        if not rows.num_rows or not pivots.num_rows:
            return pa.table([rows["gid"], rows["vec"], pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        similarity = matrix(rows["vec"]) @ matrix(pivots["pivot"]).T
        best = similarity.argmax(axis=1)
        angle = _angle(similarity[np.arange(len(best)), best])
        return pa.table([rows["gid"], rows["vec"], pa.array(pivots["child"].to_numpy()[best]), pa.array(angle)], names=names)

    return assign


def pivot_tree(vectors: DataFrame, block_rows: int, fan: int = FAN, roots: int = 1) -> Tree:
    """The tree over (gid, vec). Pivots are chosen by hash and steer the cost, never the result.

    A column ``root`` (0 to ``roots`` - 1) gives each root a tree of its own; its number is
    the node number modulo ``roots``. A cell of one direction only is not divided.
    """
    row = "gid long, vec array<double>, node long, angle double"
    top = F.col("root") if "root" in vectors.columns else F.lit(0)
    rows = materialize(vectors.select("gid", "vec", top.cast("long").alias("node"), F.lit(math.pi).alias("angle")), "tree-rows")
    done, nodes, depth = [], [], 0
    while True:
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("wide"))
        crowded = sizes.where((F.col("rows") > block_rows) & (F.col("wide") > ANGLE_SLACK)).drop("wide")
        if depth == MAX_DEPTH or crowded.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(crowded.select("node"), "node", "left_anti"))
        # parts of a cell meet its pivots apart, so that no task holds a large cell
        divided = rows.join(crowded, "node").withColumn("parts", F.ceil(F.col("rows") / (8 * block_rows)).cast("int"))
        order = [F.xxhash64("gid", F.lit(depth)), F.col("gid")]
        chosen = top_n_per_group(divided.select("node", "gid", "parts"), ["node"], order, fan)
        place = F.row_number().over(Window.partitionBy("node").orderBy("gid"))
        child = (F.floor(F.col("node") / roots) * fan + place) * roots + F.pmod("node", F.lit(roots))
        pivots = chosen.withColumn("child", child).join(vectors.select("gid", F.col("vec").alias("pivot")), "gid")
        pivots = materialize(pivots.select("node", "child", "pivot", "parts"), "tree-pivots")
        each = pivots.select("node", "child", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = divided.select("node", "gid", "vec", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int").alias("part"))
        rows = materialize(dealt.groupBy("node", "part").cogroup(each.groupBy("node", "part")).applyInArrow(_assign(), row), "tree-rows")
        depth += 1
        balls = rows.groupBy("node").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows"))
        leaf = F.lit(depth == MAX_DEPTH) | (F.col("rows") <= block_rows) | (F.col("radius") <= ANGLE_SLACK)
        level = pivots.select(F.col("child").alias("node"), F.col("node").alias("parent"), "pivot").join(balls, "node")
        nodes.append(level.select("node", "parent", "pivot", "radius", leaf.alias("leaf"), F.lit(depth).alias("level")))
    placed = reduce(DataFrame.unionByName, done).select("gid", "vec", F.col("node").alias("cell"))
    return Tree(placed, materialize(reduce(DataFrame.unionByName, nodes), "tree-nodes") if nodes else None, depth)


def _laid_out(tree: Tree, fan: int, block_rows: int, groups: int, rows: int) -> DataFrame:
    """(gid, vec, cell, block, place, group): where every row goes.

    A cell is cut into blocks of about equal, bounded size; ``groups`` groups of about as
    many rows hold blocks of cells that lie side by side in the tree.
    """
    sizes = tree.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    if tree.depth:
        # the first cell below on the last level: cells in the order of the tree
        deeper = [fan ** (tree.depth - level) for level in range(1, tree.depth + 1)]
        wide = F.element_at(F.array(*[F.lit(n) for n in deeper]), F.col("level"))
        before = F.element_at(F.array(*[F.lit(sum(fan**i for i in range(tree.depth - level))) for level in range(1, tree.depth + 1)]), F.col("level"))
        levels = tree.nodes.select(F.col("node").alias("cell"), "level")
        sizes = sizes.join(levels, "cell").withColumn("place", F.col("cell") * wide + before).drop("level")
    else:
        sizes = sizes.withColumn("place", F.lit(0).cast("bigint"))
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("rows") / F.lit(block_rows)).cast("int"), "all": F.lit(0)})
    sizes = materialize(running_total(sizes, "all", "place", F.col("rows"), "upto"), "cells")
    middle = F.col("upto") - F.col("rows") + (F.col("block") + 0.5) * F.col("rows") / F.col("blocks")
    group = F.least(F.lit(groups - 1), F.floor(middle / -(-rows // groups))).cast("int")
    blocked = tree.placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    return blocked.select("gid", "vec", "cell", "block", "place", group.alias("group"))


def _pack_blocks(laid_out: DataFrame) -> DataFrame:
    """One row per block: its group, cell and place, ids and vectors."""
    return laid_out.groupBy("group", "place", "cell", "block").agg(
        F.collect_list(F.struct("gid", "vec")).alias("rows")
    )


def _sides(batches, k: int, floor: float, alone: bool) -> Iterator[tuple[Side, Side, np.ndarray | None]]:
    """The two groups of every pair of a task, or a group ``alone`` twice, and which of their cells want to meet.

    A group whose partner was not sent has nothing to meet.
    """
    pairs = defaultdict(lambda: defaultdict(lambda: ([], [])))
    for batch in batches:
        pair, group = batch.column("pair").to_numpy(), batch.column("group").to_numpy()
        place, cell = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("place", "cell"))
        for i in range(batch.num_rows):
            blocks, bounds = pairs[pair[i]][group[i]]
            if batch.column("kth")[i].is_valid:
                entries = batch.column("kth").slice(i, 1).flatten()
                bounds.append((entries.field("gid").to_numpy().copy(), entries.field("kth").to_numpy().copy()))
            else:
                rows = batch.column("rows").slice(i, 1).flatten()
                wanted = batch.column("wanted").slice(i, 1).flatten().to_numpy().copy()
                blocks.append((place[i], cell[i], rows.field("gid").to_numpy().copy(), matrix(rows.field("vec")), wanted))
    while pairs:
        _, both = pairs.popitem()
        found = []
        for group in sorted(both):
            blocks, bounds = both.pop(group)
            blocks.sort(key=lambda block: block[:2])
            names = list(dict.fromkeys(int(block[1]) for block in blocks))
            number = {name: at for at, name in enumerate(names)}
            ids = np.concatenate([block[2] for block in blocks] or [np.zeros(0, np.int64)])
            vecs = np.concatenate([block[3] for block in blocks]) if blocks else np.zeros((0, 0))
            cells = np.repeat([number[int(block[1])] for block in blocks], [len(block[2]) for block in blocks]).astype(np.int64)
            wants = {int(block[1]): block[4] for block in blocks}
            del blocks
            kth = np.full(len(ids), floor)
            if bounds:
                known, least = (np.concatenate(x) for x in zip(*bounds))
                order = np.argsort(known)
                known, least = known[order], least[order]
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                kth = np.where(known[at] == ids, np.maximum(least[at], floor), floor)
            found.append((side(ids, vecs, cells, kth, k), number, wants))
        if alone:
            yield found[0][0], found[0][0], None
        elif len(found) == 2:
            (a, of_a, wants_a), (b, of_b, wants_b) = found
            wanted = np.zeros((len(of_a), len(of_b)), dtype=bool)
            for number, others, wants, out in ((of_a, of_b, wants_a, wanted), (of_b, of_a, wants_b, wanted.T)):
                for cell, cells_b in wants.items():
                    out[number[cell], [others[c] for c in cells_b.tolist() if c in others]] = True
            del found
            yield a, b, wanted


def _best_of_pairs(pairs: DataFrame, tasks: int, k: int, floor: float, alone: bool) -> DataFrame:
    """Best ``k`` partners per row within each pair of groups, none below ``floor``.

    ``pairs`` numbers them from 0 in ``pair``; each is met in a task of its own. The rows of
    a group ``alone`` all meet each other; of two groups the rows of the cells that are
    ``wanted`` meet, and rows that have a ``kth`` look for no worse.
    """

    def best(batches):
        for a, b, wanted in _sides(batches, k, floor, alone):
            meet(a, b, wanted)
            for x in (a,) if alone else (a, b):
                src, dst, sim = x.best()
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim)], names=["src", "dst", "sim"])

    dealt = pairs.select("pair", "group", "place", "cell", "rows", "wanted", "kth").repartitionById(tasks, F.col("pair"))
    return dealt.mapInArrow(best, "src long, dst long, sim double")


def _walk(unit: bool):
    """The nodes of one level that some cells of a bucket may need, and these cells."""

    def walk(balls: pa.Table, nodes: pa.Table) -> pa.Table:
        cells = np.sort(balls["cell"].to_numpy())
        order = np.argsort(balls["cell"].to_numpy())
        near = np.zeros((len(cells), nodes.num_rows), dtype=bool)
        if near.size:
            lists = nodes["alive"].combine_chunks()
            near[np.searchsorted(cells, lists.flatten().to_numpy()), entry_rows(lists)] = True
            if unit:
                between = _angle(matrix(balls["centre"])[order] @ matrix(nodes["pivot"]).T)
                reach, needed = (balls[name].to_numpy()[order, None] for name in ("reach", "needed"))
                near &= ~(between - reach - nodes["radius"].to_numpy() > needed + ANGLE_SLACK)
        at, which = np.nonzero(near.T)
        counts = np.bincount(at, minlength=nodes.num_rows)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        alive = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells[which] if len(cells) else np.zeros(0, np.int64)))
        out = pa.table([nodes["of"], nodes["node"], nodes["leaf"], alive], names=["bucket", "at", "leaf", "alive"])
        return out.filter(pa.array(counts > 0))

    return walk


def cells_to_visit(tree: Tree, bounds: DataFrame, unit: bool) -> DataFrame:
    """(cell, cell_b): other cells that may still hold a better partner of a row of the cell.

    ``bounds`` has (cell, needed): the largest angle at which a partner is still wanted.
    Cells walk down the tree in buckets, and a bucket meets a node once, with the cells that
    got there.
    """
    counts = {r["level"]: (r["nodes"], r["leaves"]) for r in tree.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("leaf").alias("leaves")).collect()}
    buckets = -(-sum(leaves for _, leaves in counts.values()) // WALK_CELLS)
    bucket = F.pmod(F.xxhash64("parent"), F.lit(buckets)).cast("int").alias("bucket")
    balls = tree.nodes.where("leaf").select(F.col("node").alias("cell"), F.col("pivot").alias("centre"), F.col("radius").alias("reach"), bucket)
    balls = materialize(balls.join(bounds, "cell"), "tree-balls")
    front = balls.groupBy("bucket").agg(F.collect_list("cell").alias("alive")).withColumn("at", F.lit(0).cast("long"))
    found = []
    for level in range(1, tree.depth + 1):
        parts = -(-counts[level][0] // WALK_NODES)
        below = tree.nodes.where(F.col("level") == level).select("node", F.col("parent").alias("at"), "pivot", "radius", "leaf")
        # the first level has at most FAN nodes
        met = front.select(F.col("bucket").alias("of"), "at", "alive").join(F.broadcast(below) if level == 1 else below, "at").drop("at")
        met = met.withColumn("part_of", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
        each = balls.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        walked = each.groupBy("bucket", "part").cogroup(met.groupBy("of", "part_of")).applyInArrow(
            _walk(unit), "bucket int, at long, leaf boolean, alive array<long>"
        )
        if level < tree.depth:  # read twice
            walked = materialize(walked, "tree-walk")
        found.append(walked.where("leaf").select(F.explode("alive").alias("cell"), F.col("at").alias("cell_b")).where("cell != cell_b"))
        front = walked.where("not leaf").drop("leaf")
    return reduce(DataFrame.unionByName, found)


def _group(cell: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(groups)).cast("int").alias("group")


def grouped_visits(visits: DataFrame, groups: int | DataFrame) -> DataFrame:
    """(cell, group, wanted): the cells to visit in each group, so that a cell is sent once per group.

    ``groups`` is a number of groups that cells are dealt to, or (cell_b, group): the groups that hold them.
    """
    placed = visits.select("cell", "cell_b", _group("cell_b", groups)) if isinstance(groups, int) else visits.join(groups, "cell_b")
    return placed.groupBy("cell", "group").agg(F.collect_list("cell_b").alias("wanted"))


def _group_pairs(visits: DataFrame, holds: DataFrame, rounds: int) -> DataFrame:
    """(cell, group, other, wanted, round, pair): the cells of a group that meet cells of another one.

    ``holds`` has (cell, group). A cell is sent where it wants others and where it is wanted, and
    one that lies in several groups meets itself there. Pairs are numbered from 0 within each round.
    """
    several = holds.groupBy("cell").count().where("count > 1").select("cell", F.col("cell").alias("cell_b"))
    visits = visits.unionByName(several)
    wants = grouped_visits(visits, holds.withColumnRenamed("cell", "cell_b"))
    wanted = visits.join(holds, "cell").select(F.col("cell_b").alias("cell"), "group").distinct()
    sent = wants.join(wanted, ["cell", "group"], "full").withColumnRenamed("group", "other").join(holds, "cell").where("group != other")
    sent = materialize(sent.withColumns({"first": F.least("group", "other"), "last": F.greatest("group", "other")}), "sent-cells")
    turn = F.pmod(F.col("first") + F.col("last"), F.lit(rounds)).alias("round")
    pairs = sent.select("first", "last", turn).distinct()
    # one row per pair of groups
    pairs = pairs.withColumn("pair", F.row_number().over(Window.partitionBy("round").orderBy("first", "last")) - 1)
    return sent.join(materialize(pairs, "group-pairs"), ["first", "last"]).drop("first", "last")


def nearest_neighbours(
    vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS, unit: bool = True,
    floor: float | None = None, fan: int = FAN, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The ``k`` most similar other rows of each row of ``vectors`` (id, vec).

    Ordered by inner product, then id. Columns: src, dst, pos (1-based), sim.
    ``unit=False`` takes vectors of any length: angles bound nothing then, so
    every cell is visited. Partners below ``floor`` are not listed; it also bounds
    from the start which cells can hold a partner.
    """
    spark = vectors.sparkSession
    least = -math.inf if floor is None else floor
    keyed = vectors.select("id", F.sha2(F.to_json("vec"), 256).alias("key"), "vec")
    keyed = materialize(keyed, "vectors")
    members = keyed.select("id", "key")
    firsts = (
        top_n_per_group(members, ["key"], [F.col("id")], k + 1)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    groups = firsts.join(sizes, "key").withColumn("gid", F.element_at("ids", 1))
    groups = materialize(groups, "vector-groups")

    distinct = keyed.select(F.col("id").alias("gid"), "vec").join(
        groups.select("gid"), "gid", "left_semi"
    )
    shape = distinct.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dims")).first()
    # a packed block stays below BLOCK_VALUES numbers, whatever the dimension
    block_rows = max(1, min(block_rows, BLOCK_VALUES // (shape["dims"] or 1)))
    if not shape["rows"]:
        return spark.createDataFrame([], "src bigint, dst bigint, pos bigint, sim double")
    tree = pivot_tree(distinct, block_rows, fan)
    per_group = max(1, min(group_rows, max(block_rows, GROUP_VALUES // (shape["dims"] or 1))))
    # so many groups that their pairs keep all cores busy
    fewest = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    parts = max(-(-shape["rows"] // per_group), min(fewest, -(-shape["rows"] // block_rows))) if tree.depth else 1
    laid_out = _laid_out(tree, fan, block_rows, parts, shape["rows"])
    blocks = materialize(_pack_blocks(laid_out), "blocks")

    nothing = {"wanted": F.lit(None).cast("array<bigint>"), "kth": F.lit(None).cast(_KTH)}
    home = blocks.withColumn("pair", F.col("group")).withColumns(nothing)
    with settings(spark, BOUNDED_BATCHES):
        near = materialize(top_by_source(_best_of_pairs(home, parts, k, least, alone=True), k), "home-neighbours")

    if parts > 1:
        rows = laid_out.select("gid", "cell", "group")
        floors = _kth_found(near, k)
        # a row with fewer than k partners so far has no bound but the given one
        needed = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.min("kth"))))
        bounds = (
            rows.join(floors, "gid", "left")
            .withColumn("kth", F.coalesce("kth", F.lit(floor).cast("double")))
            .groupBy("cell")
            .agg(F.when(F.count("kth") == F.count(F.lit(1)), needed).otherwise(F.lit(math.pi)).alias("needed"))
        )
        visit = materialize(cells_to_visit(tree, materialize(bounds, "cell-bounds"), unit), "visits")
        # each group meets all others: in as many rounds as keep what is moved in one to a few copies of the rows
        moved = (parts - 1) * shape["rows"] * (shape["dims"] or 1) * 8
        rounds = -(-moved // max(ROUND_BYTES, ROUND_COPIES * moved // (parts - 1)))
        holds = blocks.select("cell", "group").distinct()
        sent = materialize(_group_pairs(visit, holds, rounds), "visits-of-groups")
        tasks = {r["round"]: r["pairs"] for r in sent.groupBy("round").agg((F.max("pair") + 1).alias("pairs")).collect()}
        for turn in sorted(tasks):
            now = sent.where(F.col("round") == turn)
            cells = now.select("pair", "cell", "group", "wanted").join(blocks, ["cell", "group"]).withColumn("kth", nothing["kth"])
            known = rows.select("gid", "group").distinct().join(_kth_found(near, k).where("kth is not null"), "gid")
            known = known.groupBy("group").agg(F.collect_list(F.struct("gid", "kth")).alias("kth"))
            known = now.select("pair", "group").distinct().join(known, "group").withColumns(
                {"place": F.lit(0).cast("bigint"), "cell": F.lit(0).cast("bigint"), "wanted": nothing["wanted"], "rows": F.lit(None).cast(blocks.schema["rows"].dataType)}
            )
            names = ["pair", "group", "place", "cell", "rows", "wanted", "kth"]
            met = cells.select(*names).unionByName(known.select(*names))
            with settings(spark, BOUNDED_BATCHES):
                found = _best_of_pairs(met, tasks[turn], k, least, alone=False)
                near = materialize(top_by_source(near.unionByName(found), k), "near-neighbours")

    # back to rows: own copies first, then the lowest ids of the near groups
    other = near.join(groups.select(F.col("gid").alias("dst"), "ids"), "dst").select(
        F.col("src").alias("gid"), "sim", F.explode("ids").alias("id")
    )
    norms = distinct.select(
        "gid", F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x).alias("sim")
    )
    own = groups.where("copies > 1").join(norms, "gid").select(
        "gid", "sim", F.explode("ids").alias("id")
    )
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("sim"), "id"))
    listed = (
        own.unionByName(other)
        .withColumn("r", rank)
        .where((F.col("r") <= k + 1) & (F.lit(floor is None) | (F.col("sim") >= least)))
        .groupBy("gid")
        .agg(F.array_sort(F.collect_list(F.struct("r", "id", "sim"))).alias("near"))
        .join(groups.select("gid", "key", "copies"), "gid")
        .drop("gid")
    )
    joined = join_hot(members, listed, ["key"], "copies", hot_limit(members.count()))
    mine = F.filter("near", lambda e: e["id"] != F.col("id"))
    return joined.select(
        F.col("id").alias("src"), F.posexplode(F.slice(mine, 1, k)).alias("p", "e")
    ).select(
        "src", F.col("e.id").alias("dst"), (F.col("p") + 1).cast("bigint").alias("pos"),
        F.col("e.sim").alias("sim"),
    )


def _kth_found(near: DataFrame, k: int) -> DataFrame:
    """(gid, kth): the ``k``-th similarity of a row that has as many partners so far."""
    floors = near.groupBy("src").agg(F.min("sim").alias("kth"), F.count(F.lit(1)).alias("found"))
    return floors.select(F.col("src").alias("gid"), F.when(F.col("found") >= k, F.col("kth")).alias("kth"))


def top_by_source(pairs: DataFrame, k: int) -> DataFrame:
    return top_n_per_group(pairs, ["src"], [F.desc("sim"), F.col("dst")], k)


def threshold_edges(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Edges of the neighbour lists that reach the threshold."""
    return neighbours.where(F.col("sim") >= threshold)
