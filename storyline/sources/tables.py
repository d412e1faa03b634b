"""Stamped tables: write a batch, read the newest batch."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

BATCH = "batch_query_time"


def latest_batch_value(df: DataFrame, batch: str = BATCH) -> DataFrame:
    """One row holding the newest batch stamp; no row when the table is empty."""
    return df.agg(F.max(batch).alias(batch)).where(F.col(batch).isNotNull())


def latest_batch(df: DataFrame, batch: str = BATCH) -> DataFrame:
    """Rows of the newest batch only.

    The newest stamp is a scalar subquery, so on a table partitioned by the
    stamp it becomes a partition filter and only one folder is read.
    """
    return df.where(F.col(batch) == df.agg(F.max(batch)).scalar())


def write_table(
    df: DataFrame | None,
    path: str,
    mode: str = "append",
    partition_by: Sequence[str] = (),
) -> None:
    """Append to, or replace, the parquet table at ``path``.

    ``None`` writes nothing. An append aligns columns by name and refuses a
    frame whose column set differs from the table's.
    """
    if df is None:
        return
    spark = df.sparkSession
    existing = table_columns(spark, path) if mode == "append" else None
    if existing is not None:
        if set(existing) != set(df.columns):
            raise ValueError(
                f"columns differ from table {path}: "
                f"missing {sorted(set(existing) - set(df.columns))}, "
                f"extra {sorted(set(df.columns) - set(existing))}"
            )
        df = df.select(*existing)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_batch(df: DataFrame | None, path: str, batch: str = BATCH) -> None:
    """Append one or more stamped batches, one folder per stamp."""
    write_table(df, path, "append", [batch])


def replace_batches(df: DataFrame, path: str, batch: str = BATCH) -> None:
    """Write stamped batches so that a replayed stamp replaces itself."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch)
        .parquet(path)
    )


def table_columns(spark: SparkSession, path: str) -> list[str] | None:
    """Columns of the parquet table at ``path``; ``None`` when there is no table."""
    try:
        return spark.read.parquet(path).columns
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table; a missing table with a known schema is an empty frame."""
    if schema is not None and table_columns(spark, path) is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def spread(df: DataFrame, key: str, most: int = 16) -> DataFrame:
    """Use all cores on a scan that comes in a handful of pieces.

    Meant for a bare scan in front of row-local text work. A scan of ``most`` pieces
    or more is returned as it is, so what is shuffled for this is never more than a
    few splits, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, most) else df


def newest_folder(df: DataFrame, batch: str = BATCH) -> int | None:
    """Newest stamp among the folders of a table partitioned by it; no file is opened."""
    found = re.findall(rf"/{re.escape(batch)}=(-?\d+)/", "\n".join(df.inputFiles()))
    return max(map(int, found), default=None)


def read_latest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest batch of a stored table, by its folders if it is partitioned by the stamp."""
    stored = read_table(spark, path, schema)
    newest = newest_folder(stored)
    return latest_batch(stored) if newest is None else stored.where(F.col(BATCH) == newest)


def save_as_table(df: DataFrame | None, name: str, overwrite: bool = False) -> None:
    """Catalog form of the same writes: replace, create, or append by name."""
    if df is None:
        return
    spark = df.sparkSession
    if overwrite or not spark.catalog.tableExists(name):
        df.write.mode("overwrite").saveAsTable(name)
        return
    columns = spark.table(name).columns
    if set(columns) != set(df.columns):
        raise ValueError(f"columns differ from table {name}")
    df.select(*columns).write.mode("append").saveAsTable(name)


def export_full_and_subset(df: DataFrame, full_path: str, subset_path: str, cut: int) -> None:
    """Write the full export once, then cut the page subset from what was written."""
    df.write.mode("overwrite").parquet(full_path)
    stored = df.sparkSession.read.schema(df.schema).parquet(full_path)
    stored.where(F.col("rrf_rank") <= cut).write.mode("overwrite").parquet(subset_path)


def collection_path(root: str, model_name: str, model_version: str) -> str:
    """Folder of the index that belongs to one model name and version."""
    return f"{root.rstrip('/')}/{model_name}-{model_version}"
