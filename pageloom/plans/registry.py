"""Queries by inventory row, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under its row's name."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def load() -> None:
    from . import algebra, costs, discovery, graphs, merging, patches, segmenting, statistics  # noqa: F401


load()
