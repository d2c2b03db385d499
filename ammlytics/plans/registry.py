"""Registry of queries: each has a Spark plan over the stand-in tables and, where SQL can say it, an independent DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ammlytics.sources.fixtures import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """sql with the definitions of the stand-in tables that it names (and of those that they name) put in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    if not head:
        return sql
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if m:
        return f"WITH {m[1] or ''}{head},\n{sql[m.end():]}"
    return f"WITH {head}\n{sql}"


def query(name: str, sql: str | None = None):
    """Registers plan(tables) -> DataFrame as ``name``."""

    def register(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, plan.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return plan

    return register
