"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import lang_ppm, line_templates, secret_forest, simhash_gray, vector_packing
from storyline.llm.common import quoted, read_table, small_batches, unused
from storyline.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they were, with ``n_chars`` of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*quoted(columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language stay; a null text or one without letters goes.

    A missing language is filled in with the predicted one. Where no row has a language
    nothing is learned, and every text with letters stays as it is. Repeated rows stay,
    and so do other columns, whatever their names.
    """
    small_batches(spark)
    model = lang_ppm.train_on(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted, sure = (unused(docs.columns, name) for name in ("_predicted", "_sure"))
    found = lang_ppm.predict(docs, model, out=(predicted, sure))
    kept = found.where(F.col(predicted) != lang_ppm.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", predicted)).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first; so do documents left without words.

    Null texts stay. Repeated rows and other columns stay, whatever their names.
    """
    counts = tuple(unused(docs.columns, name) for name in ("_lines", "_gone"))
    kept = line_templates.drop_recurring(docs, out=counts)
    return _measured(kept.where((F.col(counts[1]) == 0) | F.col("text").rlike(r"\S")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by their SimHash fingerprints one stays, that of the smallest doc_id.

    Fingerprints are of four-word shingles and link at 4 or fewer differing bits. A row
    with an id goes before one without; of several texts under one id, or without any,
    the one of least hash. Different texts that are not linked stay, under one id or
    none. Null and empty texts are linked like any other. Of repeated rows one stays, and
    of rows that differ in other columns alone the first in the order of those.
    """
    small_batches(spark)
    row_id = F.struct(
        F.col("doc_id").isNull().alias("without"),
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
    )
    groups = simhash_gray.near_components(docs.select(row_id.alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    others = quoted([c for c in docs.columns if c not in ("doc_id", "text")])
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(row_id.alias("key"), order.alias("order"), F.struct(*quoted(docs.columns)).alias("row"))
    stay = rows.join(kept, F.col("key") == F.col("kept"), "left_semi")
    return stay.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes, null texts stay null."""
    small_batches(spark)
    return _measured(secret_forest.redact(docs, secret_forest.scan(docs)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids; a null text is empty."""
    small_batches(spark)
    pieces = vector_packing.pack_documents(docs, VOCABULARY)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids",
        "doc_tokens", "sequence_id", "offset",
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: No SQL: context trees, fingerprints, a forest and packing are beyond it (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the stored result of the one before."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
