"""Registry of named queries over the driver tables.

Each entry is a ``(spark, sf_dir) -> DataFrame`` callable plus, where the
result is expressible in SQL, the equivalent DuckDB SQL over the same
tables (used as an independent oracle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tabprobe.plans import (  # noqa: F401
        q_columns, q_csv, q_domains, q_filters, q_groups, q_page_tables, q_pages, q_profile, q_series, q_sketches,
        q_sources)
