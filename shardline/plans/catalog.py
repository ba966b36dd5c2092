"""Registered queries: one per operator of the inventory, each over the
driver tables at ``sf_dir``, with an independent DuckDB SQL oracle where
one can be written.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame; computed
columns carry the same names in the Spark result and in the SQL.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from shardline.plans import q_topic  # noqa: F401
    from shardline.plans import q_relational  # noqa: F401
    from shardline.plans import q_scalars  # noqa: F401
    from shardline.plans import q_sources  # noqa: F401
    from shardline.plans import q_streams  # noqa: F401
