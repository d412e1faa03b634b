"""A stored cell index of dense vectors, and the search that walks it.

Every topic has a pivot tree of its own over the directions of its chunks. The chunks
of a leaf are packed into blocks of bounded size, stored by topic. A batch of questions
is a table from end to end: each question first reads the cells of the nearest pivots,
and its k-th score there is an angle to beat. Then it walks down the trees of the topics
it asks for, and a node is passed over if the angle to its pivot, less the radius of its
ball, is larger than that. What is passed over holds no better chunk and no equal one, so
the result is that of a scan of all chunks. A question of the general category walks
every tree, and the others still walk their own only.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions.vectors import inner_product
from storyline.operators.blocks import best_per_row, matrix
from storyline.operators.densejoin import ANGLE_SLACK, BLOCK_VALUES, FAN, pivot_tree
from storyline.operators.skew import dense_row_id, top_n_per_group
from storyline.session import BOUNDED_BATCHES, materialize, settings

CELL_ROWS = 4096
#: Cells that a question reads before it has an angle to beat.
FIRST_CELLS = 2
#: Questions that meet the blocks of a cell together.
QUESTION_BLOCK = 512

CELL = "root long, cell long, block int, rows array<struct<chunk_id: long, dense: array<float>, norm2: double>>"
NODE = "node long, parent long, pivot array<double>, radius double, leaf boolean, level int"
ROOT = "topic string, root long"
HIT = "question_id long, chunk_id long, score double"


class DenseIndex(NamedTuple):
    """Packed cells, the nodes of all trees (level 0 are the roots), and each topic's root."""

    cells: DataFrame
    nodes: DataFrame
    roots: DataFrame


def _direction() -> Column:
    return F.transform("dense", lambda x: x.cast("double") / F.sqrt("norm2"))


def write_cells(chunks: DataFrame, path: str, cell_rows: int = CELL_ROWS, fan: int = FAN) -> None:
    """Store the index of (chunk_id, topic, dense, norm2) below ``path``; ``chunks`` should be a stored table.

    Chunks without a vector or with a zero one are in no cell. A null topic has its own tree.
    """
    spark = chunks.sparkSession
    filled = chunks.where("norm2 > 0").select("chunk_id", "topic", "dense", "norm2")
    roots = dense_row_id(chunks.select("topic").distinct(), ["topic"], "root")
    roots.select("topic", F.col("root").cast("long")).write.parquet(f"{path}/cell-roots")
    roots = spark.read.schema(ROOT).parquet(f"{path}/cell-roots")
    facts = filled.agg(F.max(F.size("dense")).alias("dims")).first()
    cell_rows = max(1, min(cell_rows, BLOCK_VALUES // (facts["dims"] or 1)))
    named = roots.select(F.col("topic").alias("_topic"), "root")
    rooted = filled.join(named, F.col("topic").eqNullSafe(F.col("_topic"))).drop("_topic")
    tree = pivot_tree(rooted.select(F.col("chunk_id").alias("gid"), _direction().alias("vec"), "root"), cell_rows, fan, roots.count())

    placed = tree.placed.select(F.col("gid").alias("chunk_id"), "cell")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    blocked = rooted.join(placed, "chunk_id").join(sizes, "cell").withColumn("block", block)
    # grouped by what it is ranged by: cells of a topic lie together, after one shuffle
    packed = blocked.repartitionByRange("root", "cell", "block").groupBy("root", "cell", "block").agg(
        F.collect_list(F.struct("chunk_id", F.col("dense").cast("array<float>").alias("dense"), F.col("norm2").cast("double").alias("norm2"))).alias("rows")
    )
    packed.write.partitionBy("root").parquet(f"{path}/cells")

    none = spark.createDataFrame([], NODE)
    below = tree.nodes.select("node", "parent", "pivot", "radius", "leaf", "level") if tree.nodes is not None else none
    parents = below.where("level = 1").select(F.col("parent").alias("root"), F.lit(False).alias("_leaf")).distinct()
    tops = roots.join(parents, "root", "left").select(
        F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("array<double>").alias("pivot"),
        F.lit(math.pi).alias("radius"), F.coalesce("_leaf", F.lit(True)).alias("leaf"), F.lit(0).alias("level"),
    )
    tops.unionByName(below).write.parquet(f"{path}/cell-nodes")


def read_cells(spark: SparkSession, path: str) -> DenseIndex:
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
    return DenseIndex(read(CELL, "cells"), read(NODE, "cell-nodes"), read(ROOT, "cell-roots"))


def _starts(asked: DataFrame, index: DenseIndex, category: str | None) -> DataFrame:
    """(question_id, vec, root) of the trees a question walks; a null category has none."""
    roots = index.roots.count()
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(roots - 1).cast("long"))).alias("root")
    if category is None:
        return asked.select("question_id", "vec", every)
    general = asked.where(F.col(category) == C.GENERAL_CATEGORY).select("question_id", "vec", every)
    own = asked.where(F.col(category) != C.GENERAL_CATEGORY).join(index.roots, F.col(category) == F.col("topic"))
    return general.unionByName(own.select("question_id", "vec", "root"))


def _level(index: DenseIndex, front: DataFrame, level: int) -> DataFrame:
    """The nodes of one level below ``front`` (question_id, root, vec, at), with the angle to their pivots."""
    nodes = index.nodes.where(F.col("level") == level).drop("level")
    met = front.join(nodes.drop("parent"), F.col("at") == F.col("node")) if level == 0 else front.join(nodes, F.col("at") == F.col("parent")).drop("parent")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner_product(F.col("vec"), F.col("pivot"))))
    # a root has no pivot: nothing is known of it
    return met.withColumn("angle", F.coalesce(F.acos(cosine), F.lit(math.pi))).withColumn("at", F.col("node")).drop("node", "pivot")


def _walk(index: DenseIndex, front: DataFrame, depth: int, keep) -> DataFrame:
    """(question_id, root, cell) of the leaves reached from ``front`` through what ``keep`` keeps of each level."""
    found = []
    for level in range(depth + 1):
        met = keep(_level(index, front, level), level)
        if level < depth:  # read twice
            met = materialize(met, "question-walk")
        found.append(met.where("leaf").select("question_id", "root", F.col("at").alias("cell")))
        front = met.where(~F.col("leaf")).drop("leaf", "radius", "angle")
    return reduce(DataFrame.unionByName, found)


def _scores(index: DenseIndex, visits: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """Best ``k`` chunks of each question in each of its cells, in blocks of questions."""
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts)).cast("int").alias("part")
    dealt = visits.join(asked.select("question_id", "dense", "norm2"), "question_id").select("root", "cell", part, F.struct("question_id", "dense", "norm2").alias("q"))
    blocks = materialize(dealt.groupBy("root", "cell", "part").agg(F.collect_list("q").alias("asked")), "question-blocks")

    def best(batches):
        for batch in batches:
            left, right = batch.column("asked"), batch.column("rows")
            for i in range(batch.num_rows):
                q, c = left.slice(i, 1).flatten(), right.slice(i, 1).flatten()
                ids, chunk_ids = q.field("question_id").to_numpy(), c.field("chunk_id").to_numpy()
                lengths = np.sqrt(q.field("norm2").to_numpy()[:, None] * c.field("norm2").to_numpy()[None, :])
                scores = matrix(q.field("dense")) @ matrix(c.field("dense")).T / lengths
                rows, cols = best_per_row(scores, chunk_ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(chunk_ids[cols]), pa.array(scores[rows, cols])], names=["question_id", "chunk_id", "score"]
                )

    return index.cells.join(blocks, ["root", "cell"]).select("asked", "rows").mapInArrow(best, HIT)


def search(questions: DataFrame, index: DenseIndex, k: int, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored chunks that hold the best ``k`` of every question, and the cells read for them.

    ``questions``: question_id, dense, norm2 and, to filter, a category column. Scores are
    cosines. Questions without a vector or with a zero one have no hits.
    """
    columns = ["question_id", "dense", "norm2"] + ([category] if category else [])
    asked = questions.where("norm2 > 0").select(*columns).withColumn("vec", _direction())
    asked = materialize(asked.withColumn("norm2", F.col("norm2").cast("double")), "asked-vectors")
    parts = max(1, math.ceil(asked.count() / QUESTION_BLOCK))
    depth = index.nodes.agg(F.max("level")).first()[0] or 0
    starts = _starts(asked, index, category).withColumn("at", F.col("root"))

    def nearest(met: DataFrame, level: int) -> DataFrame:
        order = [F.col("angle"), F.col("at")]
        if level:
            return top_n_per_group(met, ["question_id"], order, FIRST_CELLS)
        if not depth:
            return top_n_per_group(met, ["question_id"], order, FIRST_CELLS)
        # the roots tell nothing; those that are divided are followed, of the others a few
        leaves = top_n_per_group(met.where("leaf"), ["question_id"], order, FIRST_CELLS)
        return met.where(~F.col("leaf")).unionByName(leaves)

    first = materialize(_walk(index, starts, depth, nearest), "first-cells")
    # a row is a cell and a block of questions, up to megabytes
    with settings(questions.sparkSession, BOUNDED_BATCHES):
        found = materialize(_scores(index, first, asked, k, parts), "first-hits")
    best = top_n_per_group(found, ["question_id"], [F.desc("score"), F.col("chunk_id")], k)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.min("score")))
    needed = best.groupBy("question_id").agg(F.when(F.count(F.lit(1)) >= k, F.acos(cosine)).otherwise(F.lit(math.pi)).alias("needed"))
    bounded = starts.join(materialize(needed, "angles"), "question_id", "left")

    def in_reach(met: DataFrame, level: int) -> DataFrame:
        return met.where(F.col("angle") - F.col("radius") <= F.coalesce("needed", F.lit(math.pi)) + ANGLE_SLACK)

    more = _walk(index, bounded, depth, in_reach).join(first, ["question_id", "root", "cell"], "left_anti")
    more = materialize(more, "more-cells")
    with settings(questions.sparkSession, BOUNDED_BATCHES):
        rest = materialize(_scores(index, more, asked, k, parts), "more-hits")
    return found.unionByName(rest), first.unionByName(more)
