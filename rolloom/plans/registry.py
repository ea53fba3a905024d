"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must return the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as 64-bit integers, the type SQL counts have."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
