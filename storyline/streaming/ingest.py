"""Land new feed files as stamped batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storyline.operators.clean import stamp_batch
from storyline.schemas import FEED_ARTICLE
from storyline.sources.feed import CORRUPT
from storyline.sources.tables import BATCH, replace_batches, table_columns


def ingest_landing(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    topic: str,
    model_name: str,
    model_version: str,
    first_stamp: int,
) -> StreamingQuery:
    """Append all files that arrived since the last run, then stop.

    A micro-batch gets the stamp ``first_stamp + batch number``, noted beside the
    checkpoint when it is first tried, and overwrites only its own partition. So a
    batch that is replayed after a failure adds nothing twice, even if the caller
    gives another ``first_stamp`` by then. Lines that cannot be read go to
    ``<table>-corrupt`` with their text, by the same stamps.
    """
    schema = T.StructType(FEED_ARTICLE.fields + [T.StructField(CORRUPT, T.StringType())])
    arrived = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(landing)

    def stamp_of(number: int) -> int:
        noted = f"{checkpoint.rstrip('/')}-stamps/{number}"
        if table_columns(spark, noted) is None:
            first = spark.createDataFrame([(first_stamp + number,)], "stamp bigint").coalesce(1)
            first.write.mode("overwrite").parquet(noted)
        return spark.read.schema("stamp bigint").parquet(noted).first()["stamp"]

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        stamp = F.lit(stamp_of(number)).cast("bigint")
        broken = batch.where(F.col(CORRUPT).isNotNull())
        good = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        replace_batches(stamp_batch(good, stamp, model_name, model_version, topic=F.lit(topic)), table)
        if not broken.isEmpty():
            replace_batches(broken.select(CORRUPT, stamp.alias(BATCH)), f"{table.rstrip('/')}-corrupt")
        batch.unpersist()

    return (
        arrived.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
