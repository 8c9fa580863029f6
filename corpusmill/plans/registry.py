"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

QUERIES: dict[str, Callable[..., Any]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def wrap(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return wrap


def _load() -> None:
    import importlib

    for module in ("text_queries", "store_queries", "retrieval_queries", "feedback_queries", "entity_queries", "enrich_queries"):
        importlib.import_module(f"corpusmill.plans.{module}")


def queries() -> dict[str, Callable[..., Any]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
