"""Answers of a model, stored by the text that was asked about, so that each text is asked once.

The store is a table of (text_hash, answer) in one folder per model name and version. A
request looks its texts up, asks the model about those that are not there, adds what
came back, and joins all answers to its rows. Failed calls are not stored: they are null
this time and are asked again the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.operators.callback import AsyncModel, call_model
from storyline.session import materialize
from storyline.sources.tables import collection_path, table_columns


@dataclass(frozen=True)
class Model:
    """A caller's model: how to reach it, what it gives, and where its answers are kept."""

    name: str
    version: str
    make_client: Callable[[], object]
    call: AsyncModel
    store: str
    answer_type: str = "string"
    options: dict = field(default_factory=dict)

    @property
    def path(self) -> str:
        return collection_path(self.store, self.name, self.version)


def _known(spark: SparkSession, model: Model) -> DataFrame:
    schema = f"text_hash string, answer {model.answer_type}"
    if table_columns(spark, model.path) is None:
        return spark.createDataFrame([], schema)
    # two runs that met a new text at once may both have stored it
    return spark.read.schema(schema).parquet(model.path).dropDuplicates(["text_hash"])


def with_answers(df: DataFrame, text: str, model: Model, out: str) -> DataFrame:
    """Add the model's answer about ``text`` to every row; a null text has none.

    Rows of equal text share one call. ``out`` replaces a column of that name.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_text_hash", F.sha2(F.col(text), 256))
    asked = hashed.where(F.col(text).isNotNull()).groupBy(F.col("_text_hash").alias("text_hash")).agg(F.first(text).alias("text"))
    known = _known(spark, model)
    new = asked.join(known.select("text_hash"), "text_hash", "left_anti")
    replies = materialize(
        call_model(new, "text_hash", "text", model.make_client, model.call, "answer", model.answer_type, **model.options), "answers"
    )
    replies.where(F.col("answer").isNotNull()).write.mode("append").parquet(model.path)
    found = known.unionByName(replies).select(F.col("text_hash").alias("_text_hash"), F.col("answer").alias(out))
    rest = [c for c in hashed.columns if c != out]
    return hashed.select(*rest).join(found, "_text_hash", "left").drop("_text_hash")
