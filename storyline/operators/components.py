"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.session import materialize


def _star(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node it sees.

    The neighbourhood of a node is reduced to its minimum before any shuffle, so
    a hub sends one row per task; its neighbours are never gathered.
    """
    a, b = F.col("a"), F.col("b")
    both = edges if smaller_only else edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if smaller_only:
        out = linked.select(b.alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    else:
        out = linked.where(b > a).select(b.alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node reached.

    Edges become stars with the root in the middle; the number of rounds grows with
    the logarithm of the longest path. Each round is written to the shared folder,
    so a lost executor costs one round.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        edges = materialize(_star(_star(edges, False), True), "stars")
        # converged once the set of links stays as it is
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(a.alias("node"), b.alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
