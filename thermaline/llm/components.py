"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node hands its larger neighbours to its smallest one; else the smaller neighbours and itself."""
    ends = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = ends.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and isn't the smallest of its component, and that smallest node.

    edges has long columns a and b. Null ends and loops are ignored; an empty table gives no rows. Every round is written to the
    shared folder, and the rounds end when one changes nothing (in the order of the logarithm of the longest path).
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    mark = _mark(now)
    while True:
        now = staged(_star(_star(now, True), False))
        if mark == (mark := _mark(now)):
            return now
