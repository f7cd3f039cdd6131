"""Registered queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Shared subqueries of the SQL side: name -> (names it builds on, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def _resolve(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _resolve(CTES[n][0], seen)
            seen.append(n)
    return seen


def with_ctes(body: str, *names: str) -> str:
    needed = _resolve(names, [])
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in needed) + "\n" + body


def query(name: str, sql: str | None = None, uses: str = "", approx: str = "", digits: int = 6):
    """Register a query. Columns in ``approx`` are rounded alike on both sides."""
    columns = approx.split()

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) for c in columns}) if columns else df

        QUERIES[name] = run
        if sql is not None:
            body = sql
            if columns:
                rounds = ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)
                body = f"SELECT * REPLACE ({rounds}) FROM ({sql}) AS q"
            SQL[name] = with_ctes(body, *uses.split())
        return build

    return register
