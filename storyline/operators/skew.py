"""Joins, ranks and row ids that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.session import materialize

MAX_HOT_KEYS = 100_000
MAX_BROADCAST_ROWS = 500_000


def hot_limit(total_rows: int) -> int:
    """Weight above which a key counts as hot.

    At most ``total_rows / limit <= MAX_HOT_KEYS`` keys can exceed it, which
    bounds what :func:`join_hot` broadcasts whatever the table size.
    """
    return max(100_000, total_rows // MAX_HOT_KEYS)


def join_hot(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, limit: int
) -> DataFrame:
    """Inner join of ``left`` with one ``right`` row per key.

    ``weight`` is the number of left rows of the key. Keys above ``limit`` are
    joined by broadcasting their right rows, so their left rows never move; all
    other keys are joined by an ordinary shuffle of evenly sized keys.
    """
    hot = right.where(F.col(weight) > limit)
    rest = right.where(F.col(weight) <= limit)
    hot_part = left.join(F.broadcast(hot), keys)
    rest_part = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return hot_part.unionByName(rest_part)


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows stay below the bound.

    ``df`` should be a stored table of short rows, so that counting is cheap;
    beyond the bound the join falls back to a shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


def _sums_before(values: DataFrame, group: str, order: str, own: str, descending: bool) -> DataFrame:
    """(_group, _at, _before, _own): sums of ``own`` over the earlier values of each group.

    ``values`` has one row per group and value. They are range-sorted by group and value
    and stored with their partition, so that a group of any size lies in as many pieces
    as it needs. Sums run inside a piece; the sums of the pieces before are carried to it
    by a join on (piece, group).
    """
    direction = F.desc_nulls_last if descending else F.asc_nulls_first
    named = values.select(F.col(group).alias("_group"), F.col(order).alias("_at"), F.col(own).alias("_own"))
    ranged = named.repartitionByRange(F.col("_group"), direction("_at")).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "ordered-values")
    piece = Window.partitionBy("_part", "_group").orderBy(direction("_at")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece of a group
    pieces = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored.groupBy("_part", "_group").agg(F.sum("_own").alias("_total")).select(
        F.col("_part").alias("_piece"), F.col("_group").alias("_of"), F.coalesce(F.sum("_total").over(pieces), F.lit(0)).alias("_carried")
    )
    inside = stored.withColumn("_inside", F.coalesce(F.sum("_own").over(piece), F.lit(0)))
    joined = inside.join(carried, (F.col("_part") == F.col("_piece")) & F.col("_group").eqNullSafe(F.col("_of")))
    return joined.select("_group", "_at", (F.col("_inside") + F.col("_carried")).alias("_before"), "_own")


def rank_in_group(df: DataFrame, group: str, value: str, out: str, descending: bool = True) -> DataFrame:
    """1-based rank of ``value`` in its group, ties share the smallest rank.

    Null and NaN values stay unranked. Equal values are one row before they are moved,
    and no task holds a whole group; the ranks are joined back by (group, value), where
    adaptive execution splits a value that many rows share.
    """
    types = dict(df.dtypes)
    clean = F.nanvl(F.col(value), F.lit(None)) if types[value] in ("double", "float") else F.col(value)
    df = df.withColumn("_value", clean)
    values = df.where(F.col("_value").isNotNull()).groupBy(group, "_value").agg(F.count(F.lit(1)).alias("_rows"))
    placed = _sums_before(values, group, "_value", "_rows", descending)
    found = df.join(placed, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_value") == F.col("_at")), "left")
    return found.withColumn(out, (F.col("_before") + 1).cast("bigint")).drop("_value", "_group", "_at", "_before", "_own")


def running_total(df: DataFrame, group: str, order: str, weight: Column, out: str) -> DataFrame:
    """Sum of ``weight`` over the rows of the group up to and including this order value.

    Rows without an order value come first. As in :func:`rank_in_group`, no task holds a
    whole group.
    """
    values = df.groupBy(group, order).agg(F.sum(weight).alias("_weight"))
    placed = _sums_before(values, group, order, "_weight", descending=False)
    found = df.join(placed, F.col(group).eqNullSafe(F.col("_group")) & F.col(order).eqNullSafe(F.col("_at")), "left")
    total = (F.col("_before") + F.col("_own")).cast("bigint")
    return found.withColumn(out, total).drop("_group", "_at", "_before", "_own")


def row_place(df: DataFrame) -> DataFrame:
    """Add the partition and the place in it of every row, to be stored with the row.

    Only what was written holds: the places of a sorted, unstored frame may change on
    a retry.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumns({"_part": F.spark_partition_id(), "_pos": place})


def with_row_number(stored: DataFrame, out: str) -> DataFrame:
    """Consecutive numbers from 0 out of the stored places, in their order."""
    # one row per partition
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_pos") + F.col("_offset"))
        .drop("_part", "_pos", "_offset")
    )


def dense_row_id(df: DataFrame, order_by: list[str], out: str = "id") -> DataFrame:
    """0-based consecutive row id in the given order, without a one-task window.

    The last order column should be unique: it splits runs of equal leading
    keys over several range partitions. Rows are range-sorted and written once,
    so the partition of a row is a stored fact and cannot change on a retry.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    return with_row_number(materialize(row_place(ranged), "row-id"), out)


def first_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """First row of each key in the given order; null keys are equal to each other.

    The ``= 1`` filter is applied per task before the shuffle, so a hot key
    sends at most one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_n_per_group(df: DataFrame, group: list[str], order_by: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; cut per task before the shuffle as well."""
    window = Window.partitionBy(*group).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
