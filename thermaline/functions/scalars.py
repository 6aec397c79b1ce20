"""One-row aggregates as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row. A scalar subquery runs once and
    fails if it ever has a second row, so no join is involved."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_s")).scalar()
    return df.withColumn("_s", row).select("*", *[F.col(f"_s.{c}").alias(c) for c in one_row.columns]).drop("_s")
