"""Model replies: text in, typed columns out, with safe defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline import constants as C
from storyline.schemas import REPLY_LISTS, REPLY_TEXTS


def strip_fence(reply: Column) -> Column:
    """Drop the code-fence characters around a reply (a set of characters, not a word)."""
    return F.regexp_replace(F.regexp_replace(reply, "^[`json]+", ""), "`+$", "")


def strip_fence_if_present(reply: Column) -> Column:
    return F.when(F.startswith(reply, F.lit("```json")), strip_fence(reply)).otherwise(reply)


def _with_object(df: DataFrame, body: Column) -> DataFrame:
    """Add the reply parsed once and its keys; no keys when it is bad or no object."""
    df = df.withColumn("_body", body).withColumn("_parsed", F.try_parse_json("_body"))
    is_object = F.schema_of_variant("_parsed").startswith("OBJECT")
    return df.withColumn("_keys", F.when(is_object, F.json_object_keys("_body")))


def _field(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col("_parsed"), f"$.{key}", kind)


def _list_field(key: str) -> Column:
    """A list of texts; a single text counts as a list of one."""
    listed, one = _field(key, "array<string>"), _field(key, "string")
    scalar = F.schema_of_variant(F.try_variant_get(F.col("_parsed"), f"$.{key}", "variant")) == "STRING"
    return F.when(scalar, F.array(one)).otherwise(listed)


def parse_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the enrichment columns and ``success``.

    Bad text and JSON that is no object give the failure record (empty lists,
    empty texts, false). A missing key gets its default; a key that is present
    with null keeps null; a text in place of a list is a list of one.
    """
    keys = F.col("_keys")
    df = _with_object(df, strip_fence(F.col(reply)))
    columns: dict[str, Column] = {}
    for name in REPLY_LISTS:
        empty = F.array().cast("array<string>")
        columns[name] = F.when(
            F.array_contains(keys, name), _list_field(name)
        ).otherwise(empty)
    for name in REPLY_TEXTS:
        columns[name] = F.when(
            F.array_contains(keys, name), _field(name, "string")
        ).otherwise(F.lit(""))
    columns["success"] = keys.isNotNull()
    return df.withColumns(columns).drop("_body", "_parsed", "_keys")


def parse_intent(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``intention`` and ``category``; any failure is (false, general).

    ``intention`` must be present; ``category`` defaults to general only when
    its key is missing.
    """
    keys = F.col("_keys")
    df = _with_object(df, strip_fence_if_present(F.col(reply)))
    valid = F.coalesce(F.array_contains(keys, "intention"), F.lit(False))
    general = F.lit(C.GENERAL_CATEGORY)
    intention = _field("intention", "boolean")
    category = F.when(
        F.array_contains(keys, "category"), _field("category", "string")
    ).otherwise(general)
    return df.withColumns(
        {
            "intention": F.when(valid, F.coalesce(intention, F.lit(False))).otherwise(F.lit(False)),
            "category": F.when(valid, category).otherwise(general),
        }
    ).drop("_body", "_parsed", "_keys")
