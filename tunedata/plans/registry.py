"""Registry of named queries: a Spark builder and (optionally) its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunedata.functions.text import WS_RUN
from tunedata.plans.fixtures import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` may use ``{WS}`` for the Unicode whitespace run pattern; ``ctes``
    names fixture CTEs to put in front of it.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(list(ctes), sql.replace("{WS}", WS_RUN))
        return fn
    return deco
