"""Registry of named queries: a Spark implementation ``(spark, sf_dir) ->
DataFrame`` and, where the semantics allow it, an equivalent DuckDB SQL
string over the raw test tables."""

from __future__ import annotations

from typing import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
