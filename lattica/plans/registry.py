"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, in_duckdb, with_fixtures

FLAGSHIP = "link_counts"
MODULES = ["q_scalar", "q_links", "q_depth", "q_tables", "q_assess"]
_found: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers a function of Inputs.  sql is the last SELECT of its oracle, ctes what goes before it;
    fixture views that either names are added."""

    def put(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in _found:
            raise ValueError(f"{name} is registered twice")
        _found[name] = (f, sql and in_duckdb(with_fixtures(sql, ctes)))
        return f

    return put


@cache
def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, f=f: f(Inputs(spark, sf_dir))) for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _found.items() if sql}
