"""Registered queries with their SQL twins; the modules of queries fill it on import."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("edge_queries", "node_queries", "selection_queries", "iterative_queries", "scoring_queries", "attention_queries", "geometry_queries", "source_queries", "structure_queries")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"rxnframe.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
