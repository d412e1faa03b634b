"""Block-max postings and the walk that searches them.

Chunks are grouped by number into ranges of :data:`RANGE_CHUNKS` and zones of
:data:`ZONE_RANGES` ranges. A block holds one word's postings of one range and topic,
with the largest count in it; a zone row holds a word's largest count in a zone. For a
question, the sum of its word weights times these counts bounds the score of every
chunk of a range or zone.

The walk scores the most promising ranges of the most promising zones first. The k-th
best score found is a threshold; only zones, then ranges, whose bound reaches it are
read after that. Nothing is left out: a chunk below the threshold cannot be among the
best k, and equal bounds are read. Blocks are joined on (zone, range, word), so the
blocks of a frequent word are spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.operators.blocks import bounded_slices, entry_rows
from storyline.operators.skew import MAX_BROADCAST_ROWS, broadcast_if_small, top_n_per_group
from storyline.session import materialize

RANGE_CHUNKS = 64
ZONE_RANGES = 64
#: Zones that share a folder of the stored blocks.
FOLDER_ZONES = 64
FIRST_ZONES = 2
FIRST_RANGES = 8
IDF_UNIT = 1_000_000

BLOCK = "topic string, zone long, range long, term string, rows long, most long, chunk_ids array<long>, tfs array<long>"


class SparseIndex(NamedTuple):
    """Stored blocks, their largest counts by zone, and the words' frequencies."""

    blocks: DataFrame
    zones: DataFrame
    frequencies: DataFrame
    total: int


def idf_weight(df: Column, total: Column) -> Column:
    """Inverse document frequency in whole millionths: sums of it are exact in any order."""
    rest = (total - df).cast("double") + 0.5
    return F.round(F.log(rest / (df + 0.5) + 1.0) * IDF_UNIT).cast("bigint")


def blocks_of(chunks: DataFrame, range_chunks: int = RANGE_CHUNKS, zone_ranges: int = ZONE_RANGES) -> DataFrame:
    """Blocks of (chunk_id, topic, sparse_terms, sparse_tf), built where the chunks lie.

    A range whose chunks lie in several batches has several blocks per word; bounds
    take the largest of them, scores add them up.
    """

    def build(batches):
        for batch in bounded_slices(batches, "sparse_terms"):
            lists = batch.column("sparse_terms")
            rows = entry_rows(lists)
            ids = batch.column("chunk_id").to_numpy()[rows]
            entries = pa.table(
                {
                    "topic": batch.column("topic").take(pa.array(rows)),
                    "zone": ids // (range_chunks * zone_ranges),
                    "range": ids // range_chunks,
                    "term": lists.flatten(),
                    "chunk_id": ids,
                    "tf": batch.column("sparse_tf").flatten().cast(pa.int64()),
                }
            )
            if not entries.num_rows:
                continue
            found = entries.group_by(["topic", "zone", "range", "term"]).aggregate(
                [("tf", "count"), ("tf", "max"), ("chunk_id", "list"), ("tf", "list")]
            )
            found = found.rename_columns(["topic", "zone", "range", "term", "rows", "most", "chunk_ids", "tfs"])
            yield from found.combine_chunks().to_batches()

    picked = chunks.select("chunk_id", "topic", "sparse_terms", "sparse_tf").where(F.size("sparse_terms") > 0)
    return picked.mapInArrow(build, BLOCK)


def write_sparse(chunks: DataFrame, path: str, range_chunks: int = RANGE_CHUNKS, zone_ranges: int = ZONE_RANGES) -> None:
    """Store the blocks of ``chunks`` below ``path``, then what is summed up from them."""
    spark = chunks.sparkSession
    blocks_of(chunks, range_chunks, zone_ranges).withColumn("folder", _folder()).write.partitionBy("folder").parquet(f"{path}/blocks")
    stored = read_blocks(spark, path)
    stored.groupBy("topic", "zone", "term").agg(F.max("most").alias("most")).write.parquet(f"{path}/zones")
    stored.groupBy("term").agg(F.sum("rows").alias("df")).write.parquet(f"{path}/frequencies")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{BLOCK}, folder long").parquet(f"{path}/blocks")


def read_sparse(spark: SparkSession, path: str, total: int) -> SparseIndex:
    zones = spark.read.schema("topic string, zone long, term string, most long").parquet(f"{path}/zones")
    frequencies = spark.read.schema("term string, df long").parquet(f"{path}/frequencies")
    return SparseIndex(read_blocks(spark, path), zones, frequencies, total)


def postings_of(blocks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of every posting."""
    listed = blocks.select("term", F.explode(F.arrays_zip("chunk_ids", "tfs")).alias("p"))
    return listed.select(F.col("p.chunk_ids").alias("chunk_id"), "term", F.col("p.tfs").alias("tf"))


def weighted_words(questions: DataFrame, index: SparseIndex, category: str | None) -> DataFrame:
    """(question_id, wanted, term, value) of every word of a question that any chunk has.

    ``wanted`` is the topic to search, null for all.
    """
    wanted = F.lit(None).cast("string")
    if category:
        wanted = F.when(F.col(category) != C.GENERAL_CATEGORY, F.col(category)).when(F.col(category).isNull(), F.lit(""))
    words = questions.select(
        "question_id", wanted.alias("wanted"), F.explode(F.arrays_zip("sparse_terms", "sparse_tf")).alias("p")
    )
    words = words.select("question_id", "wanted", F.col("p.sparse_terms").alias("term"), F.col("p.sparse_tf").alias("tf"))
    value = F.col("tf") * idf_weight(F.col("df"), F.lit(index.total))
    return words.join(index.frequencies, "term").select("question_id", "wanted", "term", value.alias("value"))


def _searched(joined: DataFrame) -> DataFrame:
    return joined.where(F.col("wanted").isNull() | (F.col("wanted") == F.col("topic")))


def zone_bounds(words: DataFrame, index: SparseIndex) -> DataFrame:
    """(question_id, topic, zone, bound): no chunk of the zone scores more."""
    joined = _searched(words.join(index.zones, "term"))
    return joined.groupBy("question_id", "topic", "zone").agg(F.sum(F.col("value") * F.col("most")).alias("bound"))


def _folder() -> Column:
    return F.floor(F.col("zone") / FOLDER_ZONES).cast("long")


def _needed(words: DataFrame, places: DataFrame, rows: int | None) -> DataFrame:
    """The words of each question with the places to look them up in.

    As long as they are few, the blocks stay where they lie: ``rows`` bounds their number;
    without it they are stored and counted.
    """
    asked = words.drop("wanted").join(places, "question_id").withColumn("folder", _folder())
    if rows is None:
        return broadcast_if_small(materialize(asked, "asked-places"))
    return F.broadcast(asked) if rows <= MAX_BROADCAST_ROWS else asked


def range_bounds(words: DataFrame, zones: DataFrame, index: SparseIndex, rows: int | None = None) -> DataFrame:
    """(question_id, topic, zone, range, bound) of the ranges in the given zones of each question.

    Several blocks of one word and range are added up, which keeps it a bound.
    """
    asked = _needed(words, zones.select("question_id", "topic", "zone"), rows)
    heads = index.blocks.select("folder", "topic", "zone", "range", "term", "most")
    joined = heads.join(asked, ["folder", "topic", "zone", "term"])
    return joined.groupBy("question_id", "topic", "zone", "range").agg(F.sum(F.col("value") * F.col("most")).alias("bound"))


def range_scores(words: DataFrame, ranges: DataFrame, index: SparseIndex, rows: int | None = None) -> DataFrame:
    """(question_id, chunk_id, score) of the chunks that share a word with the question, in its given ranges."""
    asked = _needed(words, ranges.select("question_id", "topic", "zone", "range"), rows)
    read = index.blocks.join(asked, ["folder", "topic", "zone", "range", "term"])
    hits = read.select("question_id", "value", F.explode(F.arrays_zip("chunk_ids", "tfs")).alias("p"))
    score = F.sum(F.col("value") * F.col("p.tfs")).alias("score")
    return hits.groupBy("question_id", F.col("p.chunk_ids").alias("chunk_id")).agg(score)


def walk(questions: DataFrame, index: SparseIndex, k: int, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored chunks that hold the best ``k`` of every question, and the ranges read for them.

    ``questions``: question_id, sparse_terms, sparse_tf and, to filter, a category column.
    Questions without a known word have no hits.
    """
    words = materialize(weighted_words(questions, index, category), "asked-words")
    zones = materialize(zone_bounds(words, index), "zone-bounds")
    best = F.desc("bound")
    first_zones = top_n_per_group(zones, ["question_id"], [best, F.col("zone"), F.col("topic")], FIRST_ZONES)
    asked = words.count()
    first = range_bounds(words, first_zones, index, asked * FIRST_ZONES)
    first = materialize(top_n_per_group(first, ["question_id"], [best, F.col("range"), F.col("topic")], FIRST_RANGES), "first-ranges")
    found = materialize(range_scores(words, first, index, asked * FIRST_RANGES), "first-scores")
    reached = top_n_per_group(found, ["question_id"], [F.desc("score"), F.col("chunk_id")], k).groupBy("question_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(0)).alias("threshold")
    )
    left = zones.join(reached, "question_id", "left").where(F.col("bound") >= F.coalesce("threshold", F.lit(0)))
    more = range_bounds(words, left, index).join(reached, "question_id", "left")
    more = more.where(F.col("bound") >= F.coalesce("threshold", F.lit(0)))
    more = materialize(more.join(first, ["question_id", "topic", "zone", "range"], "left_anti"), "more-ranges")
    hits = found.unionByName(range_scores(words, more, index))
    places = ["question_id", "topic", "zone", "range"]
    return hits, first.select(*places).unionByName(more.select(*places))
