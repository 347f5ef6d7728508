"""The query and oracle tables, and the SQL building blocks the oracles share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.sources.adapter import Model
from merchantry.sources.ship import ship

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def _model(spark: SparkSession, directory: str) -> Model:
    ship(spark)  # some queries merge JSON in Python workers
    return Model(spark, directory)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the model under `name`, with the SQL for the same rows."""

    def register(fn: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, directory: fn(_model(spark, directory))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def _needed(sql: str, found: dict[str, None], within: tuple[str, ...] = ()) -> None:
    for name in CTES:
        if name not in found and name not in within and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], found, (*within, name))
            found[name] = None


def with_ctes(sql: str) -> str:
    """The statement preceded by the shared definitions it mentions."""
    found: dict[str, None] = {}
    _needed(sql, found)
    if not found:
        return sql
    shared = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in found)
    own = re.sub(r"^\s*WITH\s", ", ", sql)  # a statement with definitions of its own continues the list
    return f"{shared}\n{own}"


# ---- SQL for exact decimals ---------------------------------------------------------------


def _half_up(numerator: str, denominator: str) -> str:
    """Whole quotient, halves away from zero, as hundredths; NULL for a zero denominator."""
    n, d = f"({numerator})", f"NULLIF({denominator}, 0)"
    whole = f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ((2 * abs({n}) + {d}) // (2 * {d})))"
    return f"CAST(CAST({whole} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2))"


def cents(money: str) -> str:
    return f"CAST(CAST({money} AS DECIMAL(38,2)) * 100 AS HUGEINT)"


def sql_mean_money(total: str, n: str) -> str:
    return _half_up(cents(total), f"CAST({n} AS HUGEINT)")


def sql_percent(part: str, whole: str) -> str:
    return _half_up(f"{cents(part)} * 10000", cents(whole))


def sql_mean(total: str, n: str) -> str:
    return f"CAST({total} AS DOUBLE) / NULLIF(CAST({n} AS DOUBLE), 0)"


def sql_rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0.0 END"


def sql_month(day: str) -> str:
    return f"CAST(year({day}) * 12 + month({day}) - 1 AS BIGINT)"
