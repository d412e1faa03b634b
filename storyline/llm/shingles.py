"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_digest


def shingle_hashes(text: str | None, words: int, seed: int = 42, fold: bool = True) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included, as unsigned integers.

    Words are runs of bytes other than ASCII white space; ``fold`` lower-cases A-Z.
    A text of fewer words has one shingle, the whole sequence; one without words none.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    found = (data.lower() if fold else data).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    lasts = (ends - 1).tolist()
    if len(found) <= words:
        digests = xxh64_digest(line, seed)
    else:
        digests = b"".join([xxh64_digest(line[a:b], seed) for a, b in zip(starts, lasts[words - 1 :])])
    return np.frombuffer(digests, ">u8").astype(np.uint64)
