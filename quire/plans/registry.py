"""Where queries are registered: a function of (spark, sf_dir), and the SQL that DuckDB runs to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name; ``sql`` gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is plain SQL; ``oracle`` if DuckDB needs other words."""
    from quire.sources.tables import run_sql

    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE_SQL[name] = oracle or text
