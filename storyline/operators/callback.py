"""Call a caller-supplied model once per row, a bounded number at a time."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.session import materialize

AsyncModel = Callable[[object, str], Awaitable[object]]


def call_model(
    df: DataFrame,
    key: str,
    item: str,
    make_client: Callable[[], object],
    model: AsyncModel,
    result: str = "reply",
    result_type: str = "string",
    max_concurrency: int = C.MAX_CONCURRENCY,
    partitions: int | None = None,
    error: str | None = None,
) -> DataFrame:
    """Keyed results of ``await model(client, item)`` for every row of ``df``.

    One client and one event loop per task, so that a client may keep pools or
    locks between batches, and at most ``max_concurrency`` calls in flight in it;
    the total in flight is that times the tasks running, which ``partitions``
    bounds. Items are taken from the Arrow batches as they come, so a task holds
    one batch at a time. A call that fails gives null for its row only; ``error``
    names a column for what it said. A client with ``aclose`` or ``close`` is
    closed in the end. Store the result if more than one action reads it: each
    action calls the model again.
    """
    key_type = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(item).cast("string").alias("_item"))
    if partitions:
        rows = rows.repartition(partitions)

    async def run(client, items: list[str]) -> list[tuple]:
        gate = asyncio.Semaphore(max_concurrency)

        async def one(text):
            async with gate:
                try:
                    return await model(client, text), None
                except Exception as failure:
                    return None, f"{type(failure).__name__}: {failure}"

        return await asyncio.gather(*[one(text) for text in items])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with asyncio.Runner() as loop:
            client = loop.run(_made(make_client))
            try:
                for batch in batches:
                    answers = loop.run(run(client, batch["_item"].tolist()))
                    found = {key: batch[key], result: pd.Series([a for a, _ in answers], dtype=object)}
                    if error:
                        found[error] = pd.Series([e for _, e in answers], dtype=object)
                    yield pd.DataFrame(found)
            finally:
                loop.run(_closed(client))

    schema = f"`{key}` {key_type}, `{result}` {result_type}"
    return rows.mapInPandas(call, schema + (f", `{error}` string" if error else ""))


async def _made(make_client: Callable[[], object]) -> object:
    return make_client()


async def _closed(client: object) -> None:
    close = getattr(client, "aclose", None) or getattr(client, "close", None)
    waiting = close() if close else None
    if asyncio.iscoroutine(waiting):
        await waiting


def merge_results(articles: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Put keyed results beside their articles; a missing result leaves nulls."""
    return articles.join(results, key, "left")


def embeddable(df: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose title is a non-empty string."""
    return df.where(F.col(title).isNotNull() & (F.col(title) != ""))


def embed_titles(
    articles: DataFrame,
    key: str,
    title: str,
    make_client: Callable[[], object],
    model: AsyncModel,
    out: str = "title_embedding",
    **options,
) -> DataFrame:
    """Left-join a vector per non-empty title; failures and empty titles stay null."""
    vectors = call_model(
        embeddable(articles, title), key, title, make_client, model, out, "array<float>", **options
    )
    # stored, as every reading would ask (and pay) the model again
    return merge_results(articles, materialize(vectors, "vectors"), key)
