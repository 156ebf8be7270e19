"""Named queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def r6(value: Column | str) -> Column:
    """Six digits, and no negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6) + F.lit(0.0)


def sql6(expression: str) -> str:
    return f"(round({expression}, 6) + 0e0)"
