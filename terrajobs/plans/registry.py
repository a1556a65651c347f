"""Registered queries: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from terrajobs.plans.fixtures import PRELUDE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query. ``sql`` follows the fixtures' common table expressions: it is a
    select, or starts with a comma and more of them."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = PRELUDE + sql
        return f

    return add
