"""Registry of queries: each applies operators to views of the supplied tables, beside an SQL text with equal results."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, ctes: str = "") -> Callable:
    """Register a query; ``oracle`` is a SELECT over the views' names, ``ctes`` more named selects before it."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = f"with {views.SQL}{', ' + ctes if ctes else ''} {oracle}"
        return fn

    return add
