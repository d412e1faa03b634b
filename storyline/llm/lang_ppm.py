"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte costs
-log2 of its probability in the longest context that was seen; a byte new there
costs an escape (distinct bytes / (total + distinct bytes)) and is looked up in the
next shorter context, down to the uniform distribution. Statistics are frozen after
training, so the exact code length of a text is a sum of table entries: one row per
context node of any language, one entry per byte and language, escapes worked in.

Bytes that training hardly saw share one symbol; within it they are uniform, which
costs every language the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import quoted, slices, utf8
from storyline.operators.skew import top_n_per_group

ORDER = 3
SYMBOLS = 64
#: Training rows per language, at most: fixes the size of the model and of the driver's work.
TRAIN_ROWS = 400
#: Bytes of training text per language, at most, in whole texts (one text may be longer).
TRAIN_BYTES = 1_600_000
#: Longer texts are learned from only where shorter ones do not fill the sample.
LONG_TEXT = 20_000
UNKNOWN = "und"
#: A text's bits count for at most this many bytes in its score, so that it stays below 1.
SCORE_BYTES = 64
SLICE_BYTES = 1 << 21


@dataclass(frozen=True)
class Model:
    """Frozen context trees of all languages."""

    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol
    node: np.ndarray  # last ORDER symbols -> row of ``cost``
    cost: np.ndarray  # [language, node * SYMBOLS + symbol] bits


def _history(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The last ORDER symbols before each one as a number; a text begins after zeros."""
    history = np.zeros(len(symbols), np.int32)
    place = np.arange(len(symbols)) - starts
    for back in range(ORDER, 0, -1):
        earlier = np.zeros(len(symbols), np.int32)
        earlier[back:] = symbols[:-back] if back < len(symbols) or back == 0 else 0
        earlier[place < back] = 0
        history = history * SYMBOLS + earlier
    return history


def train(texts: list[tuple[str, str]]) -> Model | None:
    """Trees from (language, text) pairs, of whole texts; None without pairs."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    raw = {lang: [t.encode("utf-8", "surrogatepass") for l, t in texts if l == lang] for lang in languages}
    seen = sum(np.bincount(np.frombuffer(b"".join(r), np.uint8), minlength=256) for r in raw.values())
    symbol = np.zeros(256, np.uint8)  # symbol 0: all other bytes, and the time before a text
    frequent = [b for b in np.argsort(-seen, kind="stable") if seen[b]][: SYMBOLS - 1]
    symbol[frequent] = np.arange(1, len(frequent) + 1)
    counts = {}
    for lang, parts in raw.items():
        data = symbol[np.frombuffer(b"".join(parts), np.uint8)]
        sizes = np.array([len(p) for p in parts])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        history = _history(data, starts).astype(np.int64)
        for order in range(ORDER + 1):
            counts[lang, order] = np.unique(
                (history % SYMBOLS**order) * SYMBOLS + data, return_counts=True
            )
    # nodes of the union of all trees; row 0 is the empty context
    node = np.zeros(SYMBOLS**ORDER, np.int32)
    rows: list[tuple[int, int]] = [(0, 0)]
    for order in range(1, ORDER + 1):
        contexts = np.unique(np.concatenate([counts[lang, order][0] // SYMBOLS for lang in languages]))
        reach = SYMBOLS ** (ORDER - order)
        for context in contexts.tolist():
            node.reshape(reach, SYMBOLS**order)[:, context] = len(rows)
            rows.append((order, context))
    depth = np.array([r[0] for r in rows])
    context = np.array([r[1] for r in rows])
    cost = np.zeros((len(languages), len(rows), SYMBOLS), np.float32)
    for n, lang in enumerate(languages):
        prob = np.full((len(rows), SYMBOLS), 1.0 / SYMBOLS)
        for order in range(ORDER + 1):
            grams, number = counts[lang, order]
            table = np.zeros((SYMBOLS**order, SYMBOLS), np.float64) if order < 3 else None
            if table is not None:
                table.reshape(-1)[grams] = number
                found = depth >= order
                own = table[context[found] % SYMBOLS**order]
            else:
                found = depth == order
                key = np.searchsorted(context[found], grams // SYMBOLS)
                own = np.zeros((int(found.sum()), SYMBOLS))
                own[key, grams % SYMBOLS] = number
            total, distinct = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                inside = own / (total + distinct)
                escape = distinct / (total + distinct)
            # an escape leaves only the symbols that are new in this context
            shorter = prob[found]
            left = np.where(own > 0, 0.0, shorter)
            mass = left.sum(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                new = np.where(own > 0, inside, escape * left / mass)
                sure = np.where(mass > 0, new, own / total)
            prob[found] = np.where(total > 0, sure, shorter)
        cost[n] = -np.log2(np.maximum(prob, 1e-12))
    others = int((symbol == 0).sum())
    cost[:, :, 0] += np.log2(max(others, 1))
    return Model(tuple(languages), symbol, node, cost.reshape(len(languages), -1))


def code_lengths(model: Model, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of every text under every language: [text, language], whole texts."""
    out = np.zeros((len(ends) - 1, len(model.languages)))
    for first, last in slices(ends, SLICE_BYTES):
        part = data[ends[first] : ends[last]]
        if not len(part):
            continue
        cuts = ends[first : last + 1] - ends[first]
        sizes = np.diff(cuts)
        symbols = model.symbol[part]
        history = _history(symbols, np.repeat(cuts[:-1], sizes))
        place = model.node[history] * np.int32(SYMBOLS) + symbols
        full = np.flatnonzero(sizes)
        for n in range(len(model.languages)):
            bits = model.cost[n][place]
            out[first + full, n] = np.add.reduceat(bits, cuts[full], dtype=np.float64)
    return out


def decide(model: Model, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the shortest code and its posterior, ties to the first language.

    The posterior comes from the mean bits per byte times at most SCORE_BYTES bytes.
    """
    best = bits.argmin(axis=1)
    gap = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(sizes, 1)[:, None]
    weights = np.exp2(-gap * np.minimum(sizes, SCORE_BYTES)[:, None])
    return best, 1.0 / weights.sum(axis=1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the languages of ``docs``, from at most ``rows`` whole texts of each.

    Texts are taken by a hash of the id and of the text, the same at every run, those of
    up to LONG_TEXT characters first, until they have TRAIN_BYTES bytes; the first text
    is taken whatever its length. They are chosen by hash and length alone, so that only
    the texts taken are moved. Rows without a language or without letters and held-out
    ids teach nothing; equal rows count as one.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    chosen = F.xxhash64("doc_id", "text")
    size = F.octet_length("text")
    narrow = labelled.select("lang", chosen.alias("order"), size.alias("size"), (F.length("text") > LONG_TEXT).alias("long"))
    order = [F.col("long"), F.col("order")]
    taken = top_n_per_group(narrow.distinct(), ["lang"], order, rows)
    before = Window.partitionBy("lang").orderBy("long", "order").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("size").over(before), F.lit(0))
    taken = taken.withColumn("before", upto).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= TRAIN_BYTES))
    # at most ``rows`` short rows per language
    keys = taken.select("lang", "order")
    texts = labelled.select("lang", chosen.alias("order"), "text").join(F.broadcast(keys), ["lang", "order"], "left_semi").distinct()
    return train([(r.lang, r.text) for r in texts.orderBy("lang", "order", "text").collect()])


def predict(
    docs: DataFrame, model: Model | None, keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` columns of every row (all of them, if not given), with lang_pred and score.

    Reads ``text`` alone. A null text, a text without letters, or any text if nothing
    was learned gives ``und`` with score 0. Repeated rows come out again. The new
    columns, named by ``out``, replace columns of that name.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out[0]}` string, `{out[1]}` double"
    rows = docs.select(F.struct(*quoted(keep)).alias("row"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = broadcast.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            if frozen is not None and letters.any():
                data, ends = utf8(batch.column(1))
                best, sure = decide(frozen, code_lengths(frozen, data, ends), np.diff(ends))
                names = np.where(letters, np.array(frozen.languages, object)[best], UNKNOWN)
                score = np.where(letters, sure, 0.0)
            columns = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64())], [*keep, *out]
            )

    return rows.mapInArrow(run, schema)
