"""Where catalogue queries register: a function of the store, and the SQL that follows the store's common tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import CTE, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name. `sql` goes after the common tables; None where SQL cannot express it."""

    def add(f: Callable[[Store], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = CTE + sql
        return f

    return add
