"""Registration of queries and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The fixture bars as common table expressions.
BARS = """
  d AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS dt,
               CAST(SUM(CAST(ROUND(l_discount*100) AS INT)-5) AS BIGINT) AS step, SUM(l_quantity) AS volume, MAX(l_tax) AS t
        FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
  c AS (SELECT symbol, dt, volume, t, ROUND(100*EXP(CAST(SUM(step) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS DOUBLE)/200),4) AS close FROM d),
  o AS (SELECT *, COALESCE(LAG(close) OVER (PARTITION BY symbol ORDER BY dt), close) AS open FROM c),
  bars AS (SELECT symbol, dt, open, ROUND(GREATEST(open,close)*(1+t/8),4) AS high, ROUND(LEAST(open,close)*(1-t/8),4) AS low, close, volume FROM o)"""


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``; ``sql`` may use the table ``bars``."""

    def put(f):
        QUERIES[name] = f
        if sql:
            uses_bars = " bars" in sql.replace("\n", " ") and "WITH d AS (SELECT l_suppkey" not in sql
            if not uses_bars:
                ORACLES[name] = sql
            else:
                s = sql.strip()
                head = "WITH RECURSIVE " if s[:15].upper() == "WITH RECURSIVE " else "WITH "
                ORACLES[name] = f"{head}{BARS}, {s[len(head):]}" if s[:5].upper() == "WITH " else f"WITH {BARS} {s}"
        return f

    return put


def r6(column: str) -> str:
    """Rounding of doubles for comparison: a nudge keeps exact half-way decimals off the edge, whatever the order of summation."""
    return f"round(CAST({column} AS DOUBLE) + 1e-9, 6)"
