"""The registered queries, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.shared import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for a query that writes files and reads them."""
    return f"{scratch_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
