"""Registered queries: each name maps to a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is SQL-expressible, to the equivalent DuckDB SQL text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("flagship", "sources", "quality", "profile", "cleaning", "features", "splits",
            "selection", "metrics", "grouped", "models", "streams")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"haze.catalog.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"haze.catalog.{m}":
                raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
