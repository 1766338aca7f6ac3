from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}

MODULES = (
    "catalog", "keys", "tags", "traces", "runs", "series", "params", "likelihood",
    "convergence", "distributions", "sampling", "fitting", "plans", "streams",
)


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"fitlake.queries.{module}")
