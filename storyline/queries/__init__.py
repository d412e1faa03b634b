"""Registered queries and their SQL, over the given tables.

Each module has ``QUERIES`` (name -> function of session and folder) and
``SQL`` (name -> the same result in SQL, where SQL can express it).
"""

from __future__ import annotations

from storyline.queries import batches, chats, cleaning, enrichment, highlight, ranking, texts

MODULES = [batches, cleaning, enrichment, ranking, highlight, texts, chats]


def all_queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: q for module in MODULES for name, q in module.SQL.items()}
