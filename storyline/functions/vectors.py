"""Expressions over dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector has no direction and turns into nulls."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def to_json_text(v: Column) -> Column:
    return F.to_json(v)


def from_json_text(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def reciprocal_rank_fusion(ranks: list[Column], k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over 1-based ranks, added in list order."""
    total = F.lit(1.0) / (F.lit(k) + ranks[0])
    for rank in ranks[1:]:
        total = total + F.lit(1.0) / (F.lit(k) + rank)
    return total
