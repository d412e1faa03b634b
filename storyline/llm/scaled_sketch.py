"""Document fingerprints by a threshold-scaled sketch.

A sketch holds every shingle hash below a fixed fraction of the hash range, so it
grows with the document: the share of a small document's sketch that is found in a
very large one's estimates its containment, and the sketch of joined documents is
the union of theirs. If no hash lies below the threshold the single smallest one is
kept; :func:`merge` follows the same rule, so merging stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import parts_for, text_bytes
from storyline.llm.shingles import shingle_hashes
from storyline.session import materialize

WORDS = 5
FRACTION = 1 / 4
HASH_BITS = 48
PART_BYTES = 16 << 20


def _kept(hashes: np.ndarray, fraction: float) -> np.ndarray:
    below = hashes[hashes < np.uint64(int(fraction * (1 << HASH_BITS)))]
    return below if len(below) else hashes[:1]


def sketch(text: str | None, words: int = WORDS, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the word shingles that lie below the threshold."""
    hashes = np.unique(shingle_hashes(text, words) >> np.uint64(64 - HASH_BITS))
    return _kept(hashes, fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of two documents together, from their sketches."""
    return _kept(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; of nothing, everything is there."""
    return 1.0 if not len(a) else len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller document in the larger one, 0 to 1.

    Documents without words are like each other and unlike all others.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return containment(small, large)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def as_text(hashes: np.ndarray) -> str:
    """Twelve hex digits per hash, ascending."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def sketches(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, fingerprint) of every row; null and empty texts have an empty fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(sketch(t, words, fraction)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next_rows(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, doc_id, text, tail) so that each part, sorted, ends with the row after its last one.

    Parts are ranges of doc_id. The first row of each part is copied to the end of
    the part before it (``tail`` true), and the very first row to the end of the
    last part; that is one row per part. Equal ids are ordered by their text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(text_bytes(docs), part_bytes)
    # one number per part: as many as there are tasks
    cuts = rows.agg(F.percentile_approx("doc_id", [n / parts for n in range(1, parts)], F.lit(20 * parts))).first()[0]
    cuts = sorted(set(cuts or []))
    # the table of cuts is as long as there are parts; it goes along as one array
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("doc_id")))
    )
    placed = rows.withColumn("part", part)
    firsts = placed.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    around = Window.orderBy("part")
    # one row per part
    before = firsts.withColumn("before", F.lag("part").over(around)).withColumn(
        "before", F.coalesce("before", F.max("part").over(Window.partitionBy()))
    )
    tails = materialize(
        before.select(F.col("before").alias("part"), "row.doc_id", "row.text", F.lit(True).alias("tail")), "tails"
    )
    return placed.select("part", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    The next document is the one with the next larger doc_id (after the last: the
    first; rows with equal ids follow each other by text, null ids come first). A
    null text is empty. A single document is its own next one. Other columns are
    not read.
    """
    rows = with_next_rows(docs, part_bytes)
    parts = parts_for(text_bytes(docs), part_bytes)
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, key, text, tail in zip(*[c.to_pylist() for c in batch.columns]):
                own = sketch(text, words, fraction)
                if held is not None and held[0] == part:
                    _, last_key, last_text, last = held
                    changed = edited(last_text, text)
                    new = sketch(changed, words, fraction)
                    out.append((
                        last_key, len(last_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(last), as_text(new), likeness(last, new), likeness(last, own),
                        resemblance(last, new), resemblance(last, own),
                    ))
                held = None if tail else (part, key, text, own)
            columns = list(zip(*out)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    names = [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "resemblance_edited", "resemblance_next",
    ]
    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, resemblance_edited double, resemblance_next double",
    )
