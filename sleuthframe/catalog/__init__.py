"""Queries over the provided tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
