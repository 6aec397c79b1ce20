"""Confirmation windows, runs and interval maths (A-1 to A-9, A-13, H-6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from thermaline.functions.roles import ID, TS
from thermaline.functions.logic import epoch, holds, num
from thermaline.operators.quantile import exact_median
from thermaline.operators.series import (
    BLOCK, CORE, block_window, split_series, with_series_columns)

KEYS = ID


def confirm_row_count(confirm_seconds: float, poll_seconds: float) -> int:
    return max(1, math.ceil(confirm_seconds / max(poll_seconds, 1.0)))


def window_rows(hours: float, poll_seconds: float, *, least: int = 1) -> int:
    return max(least, math.ceil(hours * 3600.0 / poll_seconds))


def min_periods(rows: int) -> int:
    return max(3, rows // 2)


def streak(raw: Column, row: Column, w: WindowSpec) -> Column:
    """Rows since the last row where `raw` was false; `row` is the row number over `w`.

    A row is confirmed when its streak has reached n, so no streak ids and no second sort
    are needed, and only n-1 earlier rows matter.
    """
    last_clear = F.max(F.when(~raw, row)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return row - F.coalesce(last_clear, F.lit(0))


def confirm_rows(df: DataFrame, raw: Column, n: int, *, out: str = "confirmed", keys=KEYS,
                 ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """A-1: true from the n-th consecutive raw row on."""
    return with_series_columns(
        df.withColumn("_raw", holds(raw)),
        lambda w: [{"_rn": F.row_number().over(w)},
                   {out: streak(F.col("_raw"), F.col("_rn"), w) >= F.lit(int(n))}],
        keys, ts, before=int(n), tiebreak=tiebreak, **kw).drop("_raw", "_rn")


def sustain_then_confirm(df: DataFrame, raw: Column, sustain: int, n: int, **kw) -> DataFrame:
    """A-4: the sustained mask starts `sustain` rows into a run and must itself last n rows,
    which is a single run of sustain + n - 1 rows."""
    return confirm_rows(df, raw, sustain + n - 1, **kw)


def median_delta(df: DataFrame, keys=KEYS, ts: str = TS, *, out: str = "_median", **kw) -> DataFrame:
    """Median sample spacing per series."""
    d = with_series_columns(df.select(*keys, ts),
                            lambda w: {"_d": epoch(ts) - epoch(F.lag(ts).over(w))},
                            keys, ts, before=1, **kw)
    return df.select(*keys).distinct().join(exact_median(d, keys, "_d", out=out), list(keys), "left")


def infer_poll(df: DataFrame, keys=KEYS, ts: str = TS, **kw) -> DataFrame:
    """A-13: median spacing, 300 s when there are fewer than two rows or it is not positive."""
    return median_delta(df, keys, ts, out="poll_seconds", **kw).withColumn(
        "poll_seconds", F.when(F.col("poll_seconds") > num(0), F.col("poll_seconds")).otherwise(num(300)))


def _with_median(df, keys, ts, poll_seconds, **kw):
    m = median_delta(df, keys, ts, **kw)
    return df.join(m, list(keys), "left").withColumn(
        "_median", F.coalesce(F.col("_median"), num(poll_seconds)))


def confirm_elapsed(df: DataFrame, raw: Column, seconds: float, *, poll_seconds: float = 300.0,
                    out: str = "confirmed", keys=KEYS, ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """A-2: true once the time covered by the run, up to the next sample, reaches `seconds`.

    Forward spacings of a run add up to (next sample - first sample of the run); the last
    sample of a series counts the median spacing.
    """
    d = _with_median(df.withColumn("_raw", holds(raw)), keys, ts, poll_seconds, **kw)

    def make(w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        t = epoch(ts)
        return [
            {"_t": t, "_next": F.lead(t).over(w), "_prev_raw": F.lag("_raw").over(w)},
            {"_from": F.max(F.when(F.col("_raw") & ~holds(F.col("_prev_raw")), F.col("_t"))).over(upto)},
            {out: F.col("_raw") & (
                F.coalesce(F.col("_next"), F.col("_t") + F.col("_median")) - F.col("_from")
                >= num(seconds))},
        ]

    return with_series_columns(d, make, keys, ts, before=1, after=1, before_seconds=max(seconds, 1.0),
                               tiebreak=tiebreak, **kw).drop(
        "_raw", "_t", "_next", "_prev_raw", "_from", "_median")


def elapsed_hours(df: DataFrame, mask: Column, *, poll_seconds: float = 300.0, out: str = "hours",
                  keys=KEYS, ts: str = TS, **kw) -> DataFrame:
    """Hours under a mask by actual spacing; the last sample counts the median spacing."""
    d = _with_median(df.withColumn("_m", holds(mask)), keys, ts, poll_seconds, **kw)
    d = with_series_columns(d, lambda w: {"_next": F.lead(epoch(ts)).over(w)}, keys, ts, after=1, **kw)
    dt = F.coalesce(F.col("_next") - epoch(ts), F.col("_median"))
    return d.groupBy(*keys).agg((F.sum(F.when(F.col("_m"), dt).otherwise(num(0))) / num(3600)).alias(out))


def forward_dt(df: DataFrame, *, cap: float | None = None, nominal: float = 300.0,
               final: float = 0.0, out: str = "dt", keys=KEYS, ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """A-7: seconds to the next sample, clipped to [0, cap]; cap None means 3 x nominal."""
    limit = num(3.0 * nominal if cap is None else cap)
    d = with_series_columns(df, lambda w: {"_next": F.lead(epoch(ts)).over(w)}, keys, ts, after=1,
                            tiebreak=tiebreak, **kw)
    gap = F.col("_next") - epoch(ts)
    return d.withColumn(out, F.when(F.col("_next").isNull(), num(final)).otherwise(
        F.greatest(num(0), F.least(gap, limit)))).drop("_next")


def dedupe_mask(df: DataFrame, mask: Column, keys=KEYS, ts: str = TS, *, out: str = "mask") -> DataFrame:
    """One row per timestamp, mask true if any duplicate is. Partial aggregation runs before
    the shuffle, so copies of one timestamp never travel."""
    return df.groupBy(*keys, ts).agg(F.max(holds(mask)).alias(out))


def hours_under_mask(df: DataFrame, mask: Column, *, cap: float | None = None, nominal: float = 300.0,
                     keys=KEYS, ts: str = TS, out: str = "hours", **kw) -> DataFrame:
    """A-8."""
    d = forward_dt(dedupe_mask(df, mask, keys, ts), cap=cap, nominal=nominal, keys=keys, ts=ts, **kw)
    return d.groupBy(*keys).agg(
        (F.sum(F.when(F.col("mask"), F.col("dt")).otherwise(num(0))) / num(3600)).alias(out))


def startup_delay(df: DataFrame, active: Column, seconds: float, poll_seconds: float, *,
                  out: str = "active", **kw) -> DataFrame:
    """A-9: a run counts as active from its row number ceil(s / poll) on (from the first row
    when that is zero)."""
    n = math.ceil(seconds / poll_seconds) if seconds > 0 else 0
    return confirm_rows(df, active, max(1, n), out=out, **kw)


def runs(df: DataFrame, flag: Column, *, keys=KEYS, ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """Runs of true rows: keys, start, end, samples, open (no later row closes the run).

    Runs inside a block are final. Only fragments that touch a block edge, at most two per
    block, are merged in a second window.
    """
    s = split_series(df.select(*keys, ts, *tiebreak, holds(flag).alias("_f")), keys, ts, before=1, **kw)
    w = block_window(keys, ts, tiebreak)
    s = s.withColumns({
        "_prev": F.lag("_f").over(w), "_prev_core": F.lag(CORE).over(w),
        "_last": F.lead(F.lit(1)).over(w).isNull(),
    })
    first_core = ~F.coalesce(F.col("_prev_core"), F.lit(False))
    s = (s.where(F.col(CORE))
          .withColumn("_new", (F.col("_f") & (first_core | ~holds(F.col("_prev")))).cast("int"))
          .withColumn("_cont", F.col("_f") & first_core & holds(F.col("_prev")))
          .withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    frag = (s.where(F.col("_f")).groupBy(*keys, BLOCK, "_id")
             .agg(F.min(ts).alias("start"), F.max(ts).alias("end"),
                  F.count(F.lit(1)).alias("samples"),
                  F.max("_cont").alias("_cont"), F.max("_last").alias("_edge")))
    edge = frag.where(F.col("_cont") | F.col("_edge"))
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    merged = (edge.withColumn("_g", F.sum((~F.col("_cont")).cast("int")).over(
                      by_start.rowsBetween(Window.unboundedPreceding, 0)))
                  .groupBy(*keys, "_g")
                  .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                       F.sum("samples").alias("samples"))
                  .drop("_g"))
    last = df.groupBy(*keys).agg(F.max(ts).alias("_series_end"))
    inner = frag.where(~F.col("_cont") & ~F.col("_edge")).select(*keys, "start", "end", "samples")
    return (inner.unionByName(merged).join(last, list(keys))
                 .withColumn("open", F.col("end") >= F.col("_series_end")).drop("_series_end"))


def confirm_episodes(df: DataFrame, flag: Column, seconds: float, **kw) -> DataFrame:
    """A-3: runs whose last - first reaches `seconds`."""
    return (runs(df, flag, **kw)
            .withColumn("duration_s", epoch("end") - epoch("start"))
            .where(F.col("duration_s") >= num(seconds)))


