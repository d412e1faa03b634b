"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query when it ends, not when they are forgotten.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a task sends to Python at a time, whatever the length of the rows.
BOUNDED_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def build_session(
    app_name: str = "storyline", master: str | None = None, shuffle_partitions: int | None = None,
    options: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (options or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster that
    folder would be lost together with its executor.
    """
    name = "spark.checkpoint.dir"
    configured = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = spark.conf.get("storyline.local.scratch", None)
    if not fallback:
        fallback = tempfile.mkdtemp(prefix="storyline-")
        spark.conf.set("storyline.local.scratch", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so retries cannot collide.

    All paths of one application share a folder, which may be dropped after it ends.
    """
    application = spark.sparkContext.applicationId
    return f"{checkpoint_root(spark)}/storyline-scratch/{application}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block only."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets every later reader
    prune columns instead of recomputing the plan behind ``df``. What was shuffled
    for it is dropped as soon as it is stored. ``codec`` names the compression of a
    large table; the session's is the default.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, {DROP_SHUFFLES: "true"}):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
