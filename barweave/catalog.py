"""All queries of the engine with their SQL oracles."""

from __future__ import annotations

from .plans import candles, files, groups, labels, learning, relational, setups, sources, windows  # noqa: F401
from .plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
