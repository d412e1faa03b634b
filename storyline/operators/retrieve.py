"""Top-k chunks for a batch of questions.

A batch of questions is small and is shipped to the tasks; the chunk table is
scanned once, every task keeps the best ``k`` chunks per question and only those
are shuffled. The size of the batch is checked: a larger one is cut into slices
of a bounded size and scanned slice by slice, with the same result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.functions.vectors import reciprocal_rank_fusion
from storyline.operators.blocks import best_matrix, matrix, merge_best
from storyline.operators.cells import DenseIndex, search
from storyline.operators.postings import SparseIndex, walk
from storyline.operators.skew import broadcast_if_small, top_n_per_group
from storyline.session import materialize

QUESTION_SLICE = 500
SCAN_ROWS = 256
#: The fields of one chunk that the model is shown, in this order.
CONTEXT_FIELDS = ("source", "content", "publishedAt", "url", "topic", "sentiment", "repeated_count", "keywords")
HITS = "question_id long, chunk_id long, score double"


def _slices(questions: DataFrame, slice_rows: int) -> list[DataFrame]:
    """Disjoint parts of the batch, each of about ``slice_rows`` questions."""
    parts = max(1, math.ceil(questions.count() / slice_rows))
    if parts == 1:
        return [questions]
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts))
    return [questions.where(part == i) for i in range(parts)]


def _scan(
    chunks: DataFrame, columns: list[str], score, ids: np.ndarray, categories: list | None, k: int
) -> DataFrame:
    """Best ``k`` chunks per question and task; ``score(batch)`` gives questions x rows."""
    filtered = categories is not None
    wanted = pa.array(categories or [], pa.string()).to_numpy(zero_copy_only=False)
    named = np.array([c is not None for c in categories or []], dtype=bool)

    def scan(batches):
        held = best_matrix(np.zeros((len(ids), 0)), np.zeros(0, dtype=np.int64), k)
        for whole in batches:
            for start in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(start, SCAN_ROWS)
                scores = score(batch)
                if filtered:
                    topics = batch.column("topic").to_numpy(zero_copy_only=False)
                    match = (wanted[:, None] == C.GENERAL_CATEGORY) | (named[:, None] & (wanted[:, None] == topics[None, :]))
                    scores = np.where(match, scores, -np.inf)
                chunk_ids = batch.column("chunk_id").to_numpy()
                held = merge_best(held, best_matrix(scores, chunk_ids, k))
        scores, chunk_ids = held
        rows, cols = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[rows], pa.int64()), pa.array(chunk_ids[rows, cols], pa.int64()),
             pa.array(scores[rows, cols], pa.float64())],
            names=["question_id", "chunk_id", "score"],
        )

    if filtered and C.GENERAL_CATEGORY not in categories:
        # topics are partitions of the stored table: the others are not read
        chunks = chunks.where(F.col("topic").isin(sorted({c for c in categories if c is not None})))
    picked = ["chunk_id", *columns] + (["topic"] if filtered else [])
    return chunks.select(*picked).mapInArrow(scan, HITS)


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    """Merge the per-task lists; ``pos`` is the 1-based place."""
    hits = parts[0]
    if len(parts) > 1:
        hits = reduce(lambda a, b: a.unionByName(b), [materialize(p, "question-slice") for p in parts])
    order = [F.desc("score"), F.col("chunk_id")]
    top = top_n_per_group(hits, ["question_id"], order, k)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return top.withColumn("pos", place.cast("bigint"))


def dense_top_k(
    chunks: DataFrame, questions: DataFrame, k: int = C.TOP_K, category: str | None = None,
    slice_rows: int = QUESTION_SLICE,
) -> DataFrame:
    """Cosine top-k. ``questions``: question_id, dense, norm2 and, to filter, a category
    column; a question of the general category searches every topic."""
    parts = []
    for part in _slices(questions, slice_rows):
        columns = ["question_id", "dense", "norm2"] + ([category] if category else [])
        rows = part.select(*columns).where("norm2 > 0").collect()
        if not rows:
            continue
        ids = np.array([r["question_id"] for r in rows], dtype=np.int64)
        vectors = np.array([r["dense"] for r in rows], dtype=np.float64)
        norms = np.array([r["norm2"] for r in rows])
        categories = [r[category] for r in rows] if category else None

        def cosine(batch, vectors=vectors, norms=norms):
            dots = vectors @ matrix(batch.column("dense")).T
            lengths = np.sqrt(norms[:, None] * batch.column("norm2").to_numpy()[None, :])
            return np.where(lengths > 0, dots / np.where(lengths > 0, lengths, 1.0), -np.inf)

        parts.append(_scan(chunks.where("norm2 > 0"), ["dense", "norm2"], cosine, ids, categories, k))
    if not parts:
        return _no_hits(chunks)
    return _ranked(parts, k)


def dense_index_top_k(
    index: DenseIndex, questions: DataFrame, k: int = C.TOP_K, category: str | None = None,
) -> DataFrame:
    """:func:`dense_top_k` through the stored cells: only cells that may hold a hit are read."""
    hits, _ = search(questions, index, k, category)
    return _ranked([hits], k)


def sparse_top_k(
    index: SparseIndex, questions: DataFrame, k: int = C.TOP_K, category: str | None = None,
) -> DataFrame:
    """Top-k by the sum of question count x chunk count x inverse document frequency.

    ``questions``: question_id, sparse_terms, sparse_tf. Chunks without a shared
    word are no hits. Weights are whole millionths, so scores are exact. The stored
    postings are searched; chunks are not read.
    """
    hits, _ = walk(questions, index, k, category)
    return _ranked([hits.withColumn("score", F.col("score").cast("double"))], k)


def _no_hits(chunks: DataFrame) -> DataFrame:
    return chunks.sparkSession.createDataFrame([], HITS + ", pos long")


def hybrid_top_k(dense: DataFrame, sparse: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Fuse two result lists by reciprocal rank; a list that lacks the chunk adds nothing."""
    d = dense.select("question_id", "chunk_id", F.col("pos").alias("dense_pos"))
    s = sparse.select("question_id", "chunk_id", F.col("pos").alias("sparse_pos"))
    both = d.join(s, ["question_id", "chunk_id"], "full_outer")
    parts = [F.coalesce(reciprocal_rank_fusion([F.col(p)]), F.lit(0.0)) for p in ("dense_pos", "sparse_pos")]
    fused = both.withColumn("score", parts[0] + parts[1])
    order = [F.desc("score"), F.col("chunk_id")]
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return fused.withColumn("pos", place.cast("bigint")).where(F.col("pos") <= k)


def rephrase(question: Column, canned: dict[str, str] = C.CANNED_QUESTIONS) -> Column:
    """A bare topic word becomes its full question; anything else stays."""
    key = F.lower(F.trim(question))
    result = F.when(F.lit(False), F.lit(""))
    for topic, text in canned.items():
        result = result.when(key == topic, F.lit(text))
    return result.otherwise(question)


def in_scope(questions: DataFrame) -> DataFrame:
    """Only questions whose intent was accepted go on."""
    return questions.where("intention")


def context_record(text: Column, metadata: str = "metadata") -> Column:
    """The eight fields shown to the model for one chunk, with their defaults."""
    m = lambda name: F.col(f"{metadata}.{name}")
    return F.struct(
        F.coalesce(m("source"), F.lit(C.UNKNOWN_SOURCE)).alias("source"),
        text.alias("content"),
        F.coalesce(m("publishedAt"), F.lit("")).alias("publishedAt"),
        F.coalesce(m("url"), F.lit("")).alias("url"),
        F.coalesce(m("topic"), F.lit("")).alias("topic"),
        F.coalesce(m("sentiment"), F.lit("")).alias("sentiment"),
        F.coalesce(m("duplicate_count"), F.lit(0)).cast("bigint").alias("repeated_count"),
        F.coalesce(m("keywords"), F.lit("")).alias("keywords"),
    )


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, context): JSON list of the records of its hits in rank order.

    Hits are at most k per question. Their number is checked: a batch of usual
    size is broadcast, so the chunk texts stay where they are.
    """
    hits = broadcast_if_small(materialize(hits, "hits"))
    records = chunks.select("chunk_id", "text", "metadata").join(hits, "chunk_id").select(
        "question_id", "pos", context_record(F.col("text")).alias("record")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", indented_json(F.col("record")).alias("json"))))
    listed = F.array_join(F.transform(ordered, lambda x: x["json"]), ",\n")
    return records.select("question_id", "pos", "record").groupBy("question_id").agg(
        F.concat(F.lit("[\n"), listed, F.lit("\n]")).alias("context")
    )


def json_value(value: Column) -> Column:
    """One value as JSON text."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def indented_json(record: Column, fields: tuple[str, ...] = CONTEXT_FIELDS) -> Column:
    """A flat record as a JSON object inside a list, two blanks per level, as the model reads it."""
    lines = [F.concat(F.lit(f'    "{name}": '), json_value(record[name])) for name in fields]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.format_string(C.PROMPT_TEMPLATE, question, context)
