"""Registry of the engine's own queries and their SQL counterparts.

The driver tables stand in for the domain: an order is a thesis, its customer the PhD candidate, its
suppliers the contributors, a nation an institution, a two-word part name a person's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from .plans import cleaning_queries, matching_queries  # noqa: E402, F401
