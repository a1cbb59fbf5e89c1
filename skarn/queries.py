"""The registered queries: each applies operators of the library to the tables of a folder."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB twin if there is one."""
    def register(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    from skarn.plans import catalogue  # noqa: F401  registers its queries when imported
