"""Query registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thermaline.plans.store import materialize
from thermaline.sources import driver_tables as D

__all__ = ["QUERIES", "Query", "history", "materialize", "query", "raw_history", "rounded", "stamp", "weather"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that last-bit differences in summation order do not show."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def history(spark, d) -> DataFrame:
    return D.history(spark, d)


def weather(spark, d) -> DataFrame:
    return D.weather(spark, d)


def raw_history(spark, d) -> DataFrame:
    return D.raw_history(spark, d)
