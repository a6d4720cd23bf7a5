"""Registration of queries together with the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *names: str):
    """Registers f(spark, sf_dir) under a name; `names` are the logical tables that the SQL reads."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(sql, *names)
        return f

    return put
