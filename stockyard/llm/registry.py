"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("archives", "centroids", "chat_format", "decontaminate", "katz", "omh", "pieces", "pii", "quality", "secrets", "sharding", "trie", "url_filter")


def _all() -> list:
    return [import_module(f"stockyard.llm.{m}") for m in MODULES]


def queries() -> dict:
    from corpus_pipeline import run

    return {k: v for m in _all() for k, v in m.QUERIES.items()} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return {k: v for m in _all() for k, v in m.ORACLE_SQL.items()} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
