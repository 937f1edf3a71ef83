"""Where queries are registered, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a query over named tables: ``@query(sql) def name(t)`` with ``t("orders")``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: table(spark, sf_dir, name))

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register
