"""The registry of queries: each applies operators to panels of the driver's tables; most have a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isopleth.sources.panels import CELLS_SQL, DAY_SQL, MONTH_SQL, WEEK_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES = {"dim": CELLS_SQL, "pm": MONTH_SQL, "pw": WEEK_SQL, "pd": DAY_SQL}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers a query under its name, with SQL whose named panels are put before it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            parts = [CTES[c] for c in ctes.split()]
            body = sql.strip()
            if parts:
                body = "WITH " + ", ".join(parts) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            SQL[name] = body
        return f

    return keep


def R(x: str, digits: int = 4) -> str:
    """Rounding in SQL, as r4 does it."""
    return f"round({x}, {digits}) + 0e0"
