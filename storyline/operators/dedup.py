"""Keep one representative of near copies and count how often a story was told."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.session import materialize

#: Open edges that one task walks through.
TASK_ROWS = 1 << 20


def duplicate_count(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``duplicate_count``: 1 plus the number of near copies listed for the row.

    Rows without edges, also those without a vector, count 1.
    """
    listed = edges.groupBy(F.col("src").alias(id_col)).agg(F.count(F.lit(1)).alias("_n"))
    return (
        nodes.join(listed, id_col, "left")
        .withColumn("duplicate_count", F.coalesce("_n", F.lit(0)) + 1)
        .drop("_n")
    )


def _walk(batches):
    """Ids that are dropped for certain, out of one piece of the edges, sorted by (dst, src).

    A piece holds all edges to the ids strictly between its first and its last target,
    so such an id is kept if each of its sources is dropped, and a source in between that
    is no target is kept. The first and the last target may go on in the next piece: they
    are dropped if a kept source is seen here, and open otherwise.
    """
    first = at = None
    kept: dict[int, bool | None] = {}  # of the targets passed: kept, dropped, or open
    hidden = waiting = False

    def settle():
        if hidden:
            kept[at] = False
        else:
            kept[at] = None if waiting or at == first else True
        return hidden

    for batch in batches:
        out = []
        for src, dst, root in zip(*[batch.column(c).to_pylist() for c in ("src", "dst", "root")], strict=True):
            if dst != at:
                if at is None:
                    first = dst
                elif settle():
                    out.append(at)
                at, hidden, waiting = dst, False, False
            state = True if root else kept.get(src, True if src > first else None)
            hidden = hidden or state is True
            waiting = waiting or state is None
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])
    if at is not None and hidden:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["id"])


def dropped_ids(edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Ids that a smaller kept id lists as its near copy.

    Walking ids upwards, a row is kept unless an earlier kept row listed it. That is a
    fixpoint over edges from smaller to larger ids: sources that are nobody's target are
    kept, their targets are dropped, edges from and to dropped ids go away, and the rest
    is looked at again.

    Each round range-partitions the open edges by (target, source) into pieces of about
    ``task_rows`` and walks all pieces at once (:func:`_walk`); what is dropped is carried
    to the next round as a table. A piece that no open edge enters is settled whole, so
    the rounds are at most as many as the pieces, and few unless one chain runs through
    all of them in the order of its ids. No task holds more than a piece, whatever the
    size of a component or the number of edges to one id. Every round is written to the
    shared folder, so the plan stays short and a lost executor costs one round.
    """
    open_edges = materialize(edges.where("src < dst").select("src", "dst").distinct(), "dedup-edges")
    dropped = open_edges.sparkSession.createDataFrame([], "id bigint")
    while rows := open_edges.count():
        targets = open_edges.select(F.col("dst").alias("src")).distinct().withColumn("_target", F.lit(True))
        marked = open_edges.join(targets, "src", "left").select("src", "dst", F.col("_target").isNull().alias("root"))
        pieces = -(-rows // task_rows)
        dealt = marked.repartitionByRange(pieces, "dst", "src").sortWithinPartitions("dst", "src")
        newly = materialize(dealt.mapInArrow(_walk, "id long").distinct(), "dedup-dropped")
        dropped = dropped.unionByName(newly)
        open_edges = materialize(
            open_edges.join(newly.withColumnRenamed("id", "dst"), "dst", "left_anti")
            .join(newly.withColumnRenamed("id", "src"), "src", "left_anti")
            .select("src", "dst"),
            "dedup-edges",
        )
    return dropped


def keep_representatives(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``nodes`` that survive the walk of :func:`dropped_ids`."""
    dropped = dropped_ids(edges).withColumnRenamed("id", id_col)
    return nodes.join(dropped, id_col, "left_anti")
