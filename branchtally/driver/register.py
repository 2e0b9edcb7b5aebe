"""A small decorator that files a query under its own name, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str, name: str | None = None) -> Callable:
        def add(run: Callable) -> Callable:
            queries[name or run.__name__] = run
            oracles[name or run.__name__] = sql
            return run

        return add

    return queries, oracles, query
