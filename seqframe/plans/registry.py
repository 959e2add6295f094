"""Where queries are entered: a name, a function of (view getter) and, where it can be said, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import duckdb_sql, view

Get = Callable[..., DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``get`` (name of a table or view -> DataFrame, see ``view``) under its name."""

    def enter(f: Callable[[Get], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name, **by: view(spark, sf_dir, name, **by))
        if sql:
            ORACLE_SQL[f.__name__] = duckdb_sql(sql)
        return f

    return enter
