"""The query catalogue: each query registers its DataFrame form and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _load() -> None:
    from listloom.plans import activity, edge, entities, extensions, extracts, fields, incremental, landed, lists, mentions, nearby, openings, scores, sites, statistics, stores, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
