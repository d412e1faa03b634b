"""Chunks, their dense and sparse vectors, and the stored index."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline import constants as C
from storyline.functions.text import document_text, first_line, words
from storyline.functions.times import zone_text
from storyline.functions.vectors import inner_product
from storyline.operators.answers import Model, with_answers
from storyline.operators.blocks import bounded_slices, entry_rows
from storyline.operators.cells import write_cells
from storyline.operators.postings import idf_weight, postings_of, read_blocks, write_sparse
from storyline.operators.skew import row_place, with_row_number
from storyline.schemas import CHUNK_METADATA
from storyline.session import BOUNDED_BATCHES, DROP_SHUFFLES, materialize, settings

BLANK = r" \t\n\r\f"
# a word with the white space behind it
WORD = rf"[^{BLANK}]+[{BLANK}]*"
# a sentence ends with a mark before white space or the end, or before a line break
SENTENCE = rf"[^{BLANK}](?s:.*?)(?:(?<=[.!?])(?=[{BLANK}]|\z)|(?=\n)|\z)[{BLANK}]*"
DENSE_DIMS = 64
#: Settings while the index is written.
BUILD = BOUNDED_BATCHES | {DROP_SHUFFLES: "true"}


def documents(df: DataFrame) -> DataFrame:
    """Document text and the metadata struct of each exported row."""
    fields = [
        zone_text(F.col(name)).alias(name) if name == "publishedAt" else F.col(name)
        for name in CHUNK_METADATA
    ]
    return df.select(
        "id",
        document_text(F.col("headline"), F.col("summary")).alias("text"),
        F.struct(*fields).alias("metadata"),
    )


def _split_words(text: Column) -> Column:
    """The words, each with the white space behind it, so that nothing is lost."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _joined(words: Column) -> Column:
    """The stretch of text that consecutive words cover."""
    return F.rtrim(F.array_join(words, ""), F.lit(" \t\n\r\f"))


def chunk_sliding(
    df: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Windows of ``size`` words, ``overlap`` of them shared with the next window.

    A row-local expression: no shuffle and no Python. ``df`` needs ``id`` and
    ``text``; other columns are carried along. Each chunk is a stretch of its text
    as it stands; (id, chunk_no) names it.
    """
    others = [c for c in df.columns if c != "text"]
    last = F.greatest(F.size("_words") - F.lit(overlap + 1), F.lit(0))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), last, F.lit(size - overlap)))
    # outer, as the plain form adds a pushed-down filter that splits the text once more
    return (
        df.withColumn("_words", _split_words(F.col("text")))
        .select(*others, "_words", F.posexplode_outer(starts).alias("chunk_no", "_start"))
        .where(F.col("_start").isNotNull())
        .withColumn("_part", F.slice("_words", F.col("_start") + 1, F.lit(size)))
        .select(
            *others,
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            F.size("_part").cast("bigint").alias("n_words"),
            _joined(F.col("_part")).alias("text"),
        )
    )


def _sentence_units(text: Column, longest: int) -> Column:
    """Words of each sentence; a sentence beyond ``longest`` words is cut into runs."""
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    listed = F.transform(sentences, _split_words)

    def runs(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws), F.lit(longest))
        return F.transform(starts, lambda s: F.slice(ws, s, F.lit(longest)))

    return F.flatten(F.transform(listed, runs))


def _pack_spans(lengths: Column, size: int, overlap: int) -> Column:
    """(first, last) unit of each chunk: units are added while they fit; the next
    chunk starts with the closing units of this one that hold at most ``overlap`` words."""
    span = "array<struct<first:int,last:int>>"

    def carried(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("words"), F.lit(True).alias("open"))

        def take(acc: Column, n: Column) -> Column:
            more = acc["open"] & (acc["words"] + n <= overlap)
            return F.when(
                more,
                F.struct((acc["units"] + 1).alias("units"), (acc["words"] + n).alias("words"),
                         F.lit(True).alias("open")),
            ).otherwise(
                F.struct(acc["units"].alias("units"), acc["words"].alias("words"), F.lit(False).alias("open"))
            )

        return F.aggregate(F.reverse(part), start, take)

    def state(spans, first, held, seen):
        return F.struct(spans.alias("spans"), first.alias("first"), held.alias("held"), seen.alias("seen"))

    def add(acc: Column, n: Column) -> Column:
        seen = acc["seen"] + 1
        tail = carried(F.slice(lengths, acc["first"], seen - acc["first"]))
        closed = F.concat(
            acc["spans"],
            F.array(F.struct(acc["first"].alias("first"), acc["seen"].alias("last"))),
        )
        return F.when(
            acc["held"] + n <= size, state(acc["spans"], acc["first"], acc["held"] + n, seen)
        ).otherwise(state(closed, seen - tail["units"], tail["words"] + n, seen))

    start = state(F.array().cast(span), F.lit(1), F.lit(0), F.lit(0))

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["first"].alias("first"), acc["seen"].alias("last")))
        return F.when(acc["seen"] > 0, F.concat(acc["spans"], rest)).otherwise(acc["spans"])

    return F.aggregate(lengths, start, add, finish)


def chunk_sentences(
    df: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of whole sentences, at most ``size`` words, closing sentences repeated
    up to ``overlap`` words. Folded inside each row over sentence lengths only. Each
    chunk is a stretch of its text as it stands; (id, chunk_no) names it."""
    others = [c for c in df.columns if c != "text"]
    return (
        df.withColumn("_units", _sentence_units(F.col("text"), size - overlap))
        .withColumn("_lengths", F.transform("_units", lambda u: F.size(u)))
        .withColumn("_spans", _pack_spans(F.col("_lengths"), size, overlap))
        # outer, as the plain form adds a pushed-down filter that packs the text once more
        .select(*others, "_units", F.posexplode_outer("_spans").alias("chunk_no", "_span"))
        .where(F.col("_span").isNotNull())
        .withColumn(
            "_part",
            F.flatten(F.slice("_units", F.col("_span.first"), F.col("_span.last") - F.col("_span.first") + 1)),
        )
        .select(
            *others,
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            F.size("_part").cast("bigint").alias("n_words"),
            _joined(F.col("_part")).alias("text"),
        )
    )


def with_title(df: DataFrame) -> DataFrame:
    """Offline title of a document: its first line."""
    return df.withColumn("title", first_line(F.col("text")))


@functools.lru_cache(1 << 16)  # the words of a slice come again in the next one
def word_bucket(word: str, dims: int) -> int:
    return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:4], 16) % dims


def vectorize(df: DataFrame, text: str = "text", dims: int = DENSE_DIMS) -> DataFrame:
    """Add the sparse vector (distinct words and counts) and the offline dense vector.

    The dense vector counts words per hash bucket; ``norm2`` is its squared
    length. Counts are whole numbers, so cosines built on them are repeatable.
    """
    schema = T.StructType(
        df.schema.fields
        + [
            T.StructField("sparse_terms", T.ArrayType(T.StringType())),
            T.StructField("sparse_tf", T.ArrayType(T.IntegerType())),
            T.StructField("dense", T.ArrayType(T.FloatType())),
            T.StructField("norm2", T.DoubleType()),
        ]
    )
    carried = df.columns

    def count(batches):
        for batch in bounded_slices(batches, "_words"):
            lists = batch.column("_words")
            rows = entry_rows(lists)
            encoded = lists.flatten().dictionary_encode()
            terms = encoded.dictionary
            width = max(len(terms), 1)
            codes = encoded.indices.to_numpy().astype(np.int64)
            keys, tf = np.unique(rows * width + codes, return_counts=True)
            row, code = keys // width, keys % width
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            buckets = np.array([word_bucket(w, dims) for w in terms.to_pylist()], dtype=np.int64)
            dense = np.zeros((batch.num_rows, dims))
            if len(row):
                np.add.at(dense, (row, buckets[code]), tf)
            ends = pa.array(np.arange(batch.num_rows + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried]
                + [
                    pa.ListArray.from_arrays(offsets, terms.take(pa.array(code))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(dense.ravel(), pa.float32())),
                    pa.array((dense * dense).sum(axis=1)),
                ],
                names=[*carried, "sparse_terms", "sparse_tf", "dense", "norm2"],
            )

    return df.withColumn("_words", words(F.col(text))).mapInArrow(count, schema)


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Use a model's dense vectors (key, dense) instead of the offline ones."""
    return _with_norm(chunks.drop("dense", "norm2").join(vectors.select(key, "dense"), key))


def _with_norm(rows: DataFrame) -> DataFrame:
    """``norm2`` of ``dense``; a row without a vector has length 0 and is no dense hit."""
    dense = F.transform(F.coalesce("dense", F.array()), lambda x: x.cast("float"))
    return rows.withColumn("dense", dense).withColumn("norm2", inner_product(F.col("dense"), F.col("dense")))


def model_vectors(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """``rows`` with the model's vector of ``text`` as ``dense``; each text is asked about once."""
    return _with_norm(with_answers(rows.drop("dense", "norm2"), text, model, "dense"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(term, df): the number of chunks that hold a word."""
    return chunks.select(F.explode("sparse_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_table(chunks: DataFrame) -> DataFrame:
    """(term, df, weight) over all chunks."""
    total = F.lit(chunks.count())
    return document_frequency(chunks).select(
        "term", "df", idf_weight(F.col("df"), total).alias("weight")
    )


def build_index(docs: DataFrame, path: str, size: int = C.CHUNK_SIZE,
                overlap: int = C.CHUNK_OVERLAP, dims: int = DENSE_DIMS, vectors: Model | None = None) -> DataFrame:
    """Write the chunk table (by topic), its postings, word frequencies and vector cells below ``path``.

    Takes what :func:`write_chunks` takes and returns its run facts.
    """
    spark = docs.sparkSession
    facts = write_chunks(docs, path, size, overlap, dims, vectors)
    add_postings(spark, path)
    add_cells(spark, path)
    return facts


def add_postings(spark: SparkSession, path: str) -> None:
    """Postings and word frequencies of the chunks stored below ``path``."""
    with settings(spark, BUILD):
        write_sparse(read_chunks(spark, path), path)


def add_cells(spark: SparkSession, path: str) -> None:
    """Vector cells of the chunks stored below ``path``."""
    with settings(spark, BUILD):
        write_cells(read_chunks(spark, path), path)


def write_chunks(docs: DataFrame, path: str, size: int = C.CHUNK_SIZE,
                 overlap: int = C.CHUNK_OVERLAP, dims: int = DENSE_DIMS, vectors: Model | None = None) -> DataFrame:
    """Write the chunk table (by topic) below ``path``, with the vectors of each chunk.

    ``vectors`` gives the dense vectors; without it they are counted words.

    ``docs`` has id, text, topic and may carry more columns. Documents are range-sorted
    by id and cut where they lie; chunks are numbered by their place, so numbers follow
    the order of (id, chunk_no) and ids of any size stay apart. Returns one row of run
    facts, counted while the chunks were written.
    """
    spark = docs.sparkSession
    seen = Observation()
    titled = docs if "title" in docs.columns else with_title(docs)
    ranged = titled.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    chunks = vectorize(row_place(chunk_sentences(ranged, size, overlap)), dims=dims)
    if vectors:  # stored first: the places of the chunks must not change while the model is asked
        chunks = model_vectors(materialize(chunks, "chunks"), "text", vectors)
    chunks = chunks.observe(
        seen,
        F.count(F.lit(1)).alias("num_chunks"),
        F.count_if(F.col("chunk_no") == 0).alias("num_docs"),
    )
    with settings(spark, BUILD):
        chunks.write.partitionBy("topic").parquet(f"{path}/chunks")
    # the reader's schema, as topics such as 2024 would be read as numbers
    spark.createDataFrame([(chunks.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    facts = seen.get
    row = (size, overlap, facts["num_docs"], facts["num_chunks"], path.rstrip("/").split("/")[-1])
    return spark.createDataFrame(
        [row],
        "chunk_size bigint, chunk_overlap bigint, num_docs bigint, num_chunks bigint, collection string",
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks, numbered consecutively in the order of (id, chunk_no)."""
    noted = spark.read.schema("schema string").parquet(f"{path}/schema").first()["schema"]
    stored = spark.read.schema(T.StructType.fromJson(json.loads(noted))).parquet(f"{path}/chunks")
    return with_row_number(stored, "chunk_id")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return postings_of(read_blocks(spark, path))
