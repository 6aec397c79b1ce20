"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from thermaline.functions.logic import num

C = F.col


def exact_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float], *, accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles, as columns by name, without holding a group's distinct values in one buffer.

    An approximate sketch brackets each quantile; the values between the brackets only count, those inside are grouped by value.
    What is ordered per group is the brackets' distinct values, a few ten-thousandths of the group at most. Groups with a
    null key or without a value are absent.
    """
    keys = list(keys)
    names, eps = list(quantiles), 3.0 / accuracy
    d = df.where(C(value).isNotNull()).select(*keys, C(value).cast("double").alias("_v"))
    edges = [min(1.0, max(0.0, q + e)) for q in quantiles.values() for e in (-eps, eps)]
    b = d.groupBy(*keys).agg(F.percentile_approx("_v", edges, accuracy).alias("_q"), F.count(F.lit(1)).alias("_n"))
    held = reduce(lambda x, y: x | y, [C("_v").between(C("_q")[2 * i], C("_q")[2 * i + 1]) for i in range(len(names))])
    below = [F.when(C("_v") > C("_q")[2 * i + 1], C("_q")[2 * i + 1]).otherwise(num("-inf")) for i in range(len(names))]
    zone = F.greatest(*below) if len(below) > 1 else below[0]
    place = F.when(held, F.struct(C("_v").alias("v"), F.lit(0).alias("z"))).otherwise(F.struct(zone.alias("v"), F.lit(1).alias("z")))
    n = d.join(b, keys).select(*keys, "_n", "_v", place.alias("_x")).groupBy(*keys, "_n", "_x").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_cum", upto)
    out = []
    for name, q in quantiles.items():
        rank = num(q) * (C("_n") - 1)
        # a rank beside a bracket is the last or the first of the values that only count
        lo, hi = (F.min(F.when(C("_cum") > r, F.struct("_cum", F.when(r == C("_cum") - C("_c"), C("_first")).otherwise(C("_last")).alias("v"))))["v"]
                  for r in (F.floor(rank), F.ceil(rank)))
        out.append((lo + (hi - lo) * (F.first(rank) - F.floor(F.first(rank)))).alias(name))
    return n.groupBy(*keys).agg(*out)


def exact_median(df: DataFrame, keys, value: str, *, out: str, accuracy: int = 10_000) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5}, accuracy=accuracy)
