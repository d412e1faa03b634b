"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch of whole texts, so that a batch of very long texts stays small.
TEXT_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_finished(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffle files of finished steps go with it.

    Twice, as Python hands its references back a moment after it drops them.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is none of ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their whole names, blanks and dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column: what partition counts are made from."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


def parts_for(total: int, per_part: int, least: int = 16) -> int:
    """Partitions of about ``per_part`` bytes each; grows with the data without a cap."""
    return max(least, -(-total // per_part))


def spread_key(key: str, parts: int) -> Column:
    """Bucket of an integer key; :func:`spread_of` gives the same number in NumPy."""
    return (F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(1_000_003)) % parts).cast("int")


def spread_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys.astype(np.int64) % 1_000_003) % parts


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column in a row, and where each begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    ends = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, size: int):
    """Row ranges of at most ``size`` bytes, or of one row if that is longer."""
    first, rows = 0, len(ends) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Roller:
    """Hashes of byte ranges of one text in constant time each (polynomial modulo 2^64)."""

    def __init__(self, seed: int):
        self._values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self._base = int(mix(np.array([seed + 77], np.uint64))[0]) | 5
        self._powers = self._inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            for name, base in (("_powers", self._base), ("_inverse", pow(self._base, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._values[data] * self._powers[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to each end; the length counts too."""
        h = (sums[end] - sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The same for every range of ``width`` bytes."""
        n = max(0, len(sums) - width)
        h = (sums[width:] - sums[:n]) * self._inverse[:n]
        return mix(h + np.uint64(width * 0x632BE59BD9B4E019 % (1 << 64)))
