"""Registry of queries: each has a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and decimals as DOUBLE, the types the oracle returns."""
    casts = {"int": "long", "smallint": "long", "tinyint": "long"}
    out = []
    for name, kind in df.dtypes:
        target = casts.get(kind, "double" if kind.startswith("decimal") else None)
        out.append(F.col(f"`{name}`").cast(target).alias(name) if target else F.col(f"`{name}`"))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _wide(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return register
