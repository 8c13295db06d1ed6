"""Shared pieces for registered queries."""

from __future__ import annotations

from ..sources.tables import READINGS_SQL

W = "PARTITION BY engine_id ORDER BY cycle"
WE = "PARTITION BY engine_id"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def with_readings(body: str, *ctes: str) -> str:
    """``WITH readings AS (...), <ctes> <body>`` for the DuckDB oracle."""
    head = "WITH " + READINGS_SQL.strip()
    for c in ctes:
        head += ",\n" + c.strip()
    return head + "\n" + body.strip()


def dbl(x: float) -> str:
    """A double literal DuckDB reads as DOUBLE (not DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"
