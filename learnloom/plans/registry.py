"""Query registry: one Spark plan per name, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from learnloom.sources import testdata

PLANS: dict[str, Callable[[testdata.Tables], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[testdata.Tables], DataFrame]):
        PLANS[name] = fn
        QUERIES[name] = lambda spark, sf_dir: fn(testdata.tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
