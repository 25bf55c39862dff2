"""All queries of the library by name, and the SQL twins of those that have one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, each read where it is asked for: t.orders, t.documents, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    for name in ("catalogue", "joins", "rollups", "sequences", "texts", "places", "entities", "ingest", "pages", "classify", "identity", "matching", "lookup", "decisions", "profiles"):
        importlib.import_module(f"larkspur.plans.{name}")
