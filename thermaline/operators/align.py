"""Alignment joins, fills and resampling (J-1 to J-13, S-9 to S-14, S-28)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import epoch, num
from thermaline.operators.confirm import median_delta
from thermaline.operators.series import carry_backward, carry_forward, ordinal, with_series_columns

C = F.col


# --- joins -----------------------------------------------------------------------------------
def latest_per(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the last in `order`. max_by combines before the shuffle, so many
    copies of one key cost one partial row per task."""
    keys, rest = list(keys), [c for c in df.columns if c not in set(keys)]
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[C(c) for c in rest])
    return (df.groupBy(*keys).agg(F.max_by(row, F.struct(*[C(o) if isinstance(o, str) else o for o in order])).alias("_r"))
              .select(*keys, "_r.*"))


def overwrite(left: DataFrame, cols, matched: Column, prefix: str = "_r_") -> DataFrame:
    """Right values replace same-named left columns where a right row was found."""
    out = {c: F.when(matched, C(prefix + c)).otherwise(C(c)) if c in left.columns else C(prefix + c) for c in cols}
    return left.withColumns(out).drop(*[prefix + c for c in cols])


def join_exact(left: DataFrame, right: DataFrame, cols, *, on=(), ts: str = TS, right_order=()) -> DataFrame:
    """J-1: left join on the timestamp, the last right row per timestamp wins."""
    keys = [*on, ts]
    order = list(right_order) or [ts, *cols]
    r = latest_per(right.where(C(ts).isNotNull()).select(*dict.fromkeys([*keys, *cols, *order])), keys, order)
    r = r.select(*keys, *[C(c).alias("_r_" + c) for c in cols], F.lit(True).alias("_hit"))
    return overwrite(left.join(r, keys, "left"), cols, F.coalesce(C("_hit"), F.lit(False))).drop("_hit")


def join_asof_previous(left: DataFrame, right: DataFrame, cols, *, on=(), ts: str = TS, left_ts: Column | None = None,
                       right_order=(), **kw) -> DataFrame:
    """J-2: the last right row at or before the left timestamp, however old.

    Both sides go into one ordered stream per key and the right values are carried forward
    across time buckets, so neither side is collected and no key is one task's work.
    """
    names = [c for c in left.columns]
    lt = C(ts) if left_ts is None else left_ts
    keys = [*on] or ["_all"]
    left_k = left if on else left.withColumn("_all", F.lit(0))
    right_k = right if on else right.withColumn("_all", F.lit(0))
    r = latest_per(right_k.where(C(ts).isNotNull()).select(*dict.fromkeys([*keys, ts, *cols, *right_order])),
                   [*keys, ts], list(right_order) or [ts, *cols])
    value = F.struct(*[C(c).alias(c) for c in cols])
    none = F.lit(None)
    lrow = F.struct(*[C(c).alias(c) for c in names])
    l_stream = left_k.where(lt.isNotNull()).select(*keys, lt.alias("_t"), F.lit(1).alias("_side"), lrow.alias("_l"))
    r_stream = r.select(*keys, C(ts).alias("_t"), F.lit(0).alias("_side"), value.alias("_v"))
    both = l_stream.unionByName(r_stream, allowMissingColumns=True)
    hit = carry_forward(both, ["_v"], keys, "_t", out=["_m"], tiebreak=("_side",), **kw).where(C("_side") == 1)
    out = hit.select("_l.*", *[C(f"_m.{c}").alias("_r_" + c) for c in cols], C("_m").isNotNull().alias("_hit"))
    undated = left.where(lt.isNull()).select(
        *names, *[none.cast(dict(right.dtypes)[c]).alias("_r_" + c) for c in cols], F.lit(False).alias("_hit"))
    return overwrite(out.unionByName(undated), cols, C("_hit")).drop("_hit")


def join_floor_hour(left: DataFrame, right: DataFrame, cols, *, on=(), ts: str = TS, right_order=(), **kw) -> DataFrame:
    """J-3/J-4: as-of on whole hours; within an hour the last right row counts."""
    hour = F.date_trunc("hour", C(ts))
    r = right.where(C(ts).isNotNull()).withColumn("_raw_ts", C(ts)).withColumn(ts, hour)
    # Only the hours that occur go through the ordered stream; the rows join on their hour.
    hours = left.where(C(ts).isNotNull()).select(*on, hour.alias(ts)).distinct()
    at = join_asof_previous(hours.withColumn("_found", F.lit(True)), r.withColumn("_r_hit", F.lit(True)), [*cols, "_r_hit"], on=on, ts=ts,
                            right_order=("_raw_ts", *right_order), **kw)
    at = at.select(*on, C(ts).alias("_hour"), *[C(c).alias("_r_" + c) for c in cols], C("_r_hit").alias("_hit"))
    out = left.withColumn("_hour", hour).join(at, [*on, "_hour"], "left").drop("_hour")
    return overwrite(out, cols, F.coalesce(C("_hit"), F.lit(False))).drop("_hit")


join_weather_15m = join_floor_hour


def resample_hourly(df: DataFrame, cols, *, on=(), ts: str = TS) -> DataFrame:
    """J-5 first half: hourly mean; the divisor is the number of rows with any number."""
    any_number = reduce(lambda a, b: a | b, [C(c).isNotNull() for c in cols])
    rows = F.count(F.when(any_number, 1))
    return (df.where(C(ts).isNotNull()).groupBy(*on, F.date_trunc("hour", C(ts)).alias(ts))
              .agg(*[F.round(F.sum(c) / rows, 4).alias(c) for c in cols]))


def join_resampled_hourly(left: DataFrame, right: DataFrame, value_cols, cols, *, on=(), ts: str = TS, **kw) -> DataFrame:
    return join_floor_hour(resample_hourly(left, value_cols, on=on, ts=ts), right, cols, on=on, ts=ts, **kw)


def site_reading_by_time(df: DataFrame, role: str, *, where: Column | None = None, out: str = "oat_f",
                         by=(SITE, TS)) -> DataFrame:
    """J-12 right side: a building's mean of a reading per timestamp."""
    ok = C(role).isNotNull() if where is None else C(role).isNotNull() & where
    return df.where(ok).groupBy(*by).agg(F.avg(role).alias(out))


def site_oat_with_fallback(df: DataFrame, role: str = "oa_t", lo: float = 40.0, hi: float = 110.0) -> DataFrame:
    """J-13: mean OAT of weather equipment per timestamp; of all equipment when no weather
    equipment of the building has a usable reading at all."""
    ok = C(role).between(lo, hi)
    wx = C(EQ).ilike("%weather%")
    by_ts = (df.where(ok).groupBy(SITE, TS)
               .agg(F.avg(F.when(wx, C(role))).alias("_wx"), F.avg(role).alias("_any")))
    have = df.where(ok & wx).groupBy(SITE).agg(F.lit(True).alias("_have"))
    return (by_ts.join(have, SITE, "left")
                 .select(SITE, TS, F.when(C("_have"), C("_wx")).otherwise(C("_any")).alias("oat_f"))
                 .where(C("oat_f").isNotNull()))


def bas_vs_web(df: DataFrame, bas: str = "oa_t", web: str = "web_oa_t") -> DataFrame:
    """J-14/B-14: site mean of BAS and web OAT per timestamp and their difference."""
    return (df.groupBy(SITE, TS).agg(F.avg(bas).alias("bas_oat_f"), F.avg(web).alias("web_oat_f"))
              .where(C("bas_oat_f").isNotNull() & C("web_oat_f").isNotNull())
              .withColumn("delta_f", C("bas_oat_f") - C("web_oat_f")))


# --- fills -----------------------------------------------------------------------------------
def _mark(df, cols, names):
    made = reduce(lambda a, b: a | b, [C(c).isNull() & C(n).isNotNull() for c, n in zip(cols, names)])
    return (df.withColumn("fill_created", made)
              .withColumns({c: F.coalesce(C(c), C(n)) for c, n in zip(cols, names)}).drop(*names))


def fill_forward(df: DataFrame, cols, *, keys=ID, ts: str = TS, **kw) -> DataFrame:
    names = [f"_f_{c}" for c in cols]
    return _mark(carry_forward(df, cols, keys, ts, out=names, **kw), cols, names)


def fill_backward(df: DataFrame, cols, *, keys=ID, ts: str = TS, **kw) -> DataFrame:
    names = [f"_f_{c}" for c in cols]
    return _mark(carry_backward(df, cols, keys, ts, out=names, **kw), cols, names)


def fill_linear(df: DataFrame, cols, *, keys=ID, ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """J-8: straight line by row position between the readings around an interior gap."""
    d = ordinal(df, keys, ts, name="_row", tiebreak=tiebreak, **kw)
    pts = [f"_pt_{c}" for c in cols]
    d = d.withColumns({p: F.when(C(c).isNotNull(), F.struct(C("_row").alias("i"), C(c).alias("v")))
                       for c, p in zip(cols, pts)})
    d = carry_forward(d, pts, keys, ts, out=[p + "a" for p in pts], tiebreak=tiebreak, **kw)
    d = carry_backward(d, pts, keys, ts, out=[p + "b" for p in pts], tiebreak=tiebreak, **kw)

    def line(p):
        a, b = C(p + "a"), C(p + "b")
        t = (C("_row") - a["i"]).cast("double") / (b["i"] - a["i"]).cast("double")
        return F.when(a.isNotNull() & b.isNotNull() & (b["i"] > a["i"]),
                      F.round(a["v"] + (b["v"] - a["v"]) * t, 4))

    names = [f"_f_{c}" for c in cols]
    d = d.withColumns({n: line(p) for n, p in zip(names, pts)})
    return _mark(d, cols, names).drop("_row", *[p + s for p in pts for s in ("", "a", "b")])


def apply_fill(df: DataFrame, policy: str, cols, **kw) -> DataFrame:
    """J-9: none, constant and acknowledge_only change nothing."""
    fills = {"forward": fill_forward, "backward": fill_backward, "linear": fill_linear}
    if policy in fills:
        return fills[policy](df, cols, **kw)
    if policy in ("none", "constant", "acknowledge_only"):
        return df.withColumn("fill_created", F.lit(False))
    raise ValueError(f"unknown fill policy {policy!r}")


# --- shape -----------------------------------------------------------------------------------
def wide_to_long(df: DataFrame, roles, *, ids=(*ID, TS)) -> DataFrame:
    """S-9: one row per reading; empty readings are dropped."""
    return (df.select(*ids, *[C(r).cast("double").alias(r) for r in roles])
              .unpivot(list(ids), list(roles), "role", "value").where(C("value").isNotNull()))


def long_to_wide(df: DataFrame, roles, *, ids=(*ID, TS), role: str = "role", value: str = "value",
                 order: str | None = None) -> DataFrame:
    """S-9: one row per (equipment, timestamp); a later reading replaces an earlier one.
    Roles are listed, so no extra pass is needed to find the pivot values."""
    def pick(r):
        v = F.when(C(role) == r, C(value))
        return F.max_by(v, F.when(C(role) == r, C(order))) if order else F.max(v)
    return df.groupBy(*ids).agg(*[pick(r).alias(r) for r in roles])


class SchemaDrift(ValueError):
    pass


def append_merge(existing: DataFrame, incoming: DataFrame, *, keys=(*ID, TS), order: str | None = None) -> DataFrame:
    """S-10: upsert by key, the incoming batch wins; extra or missing columns are an error."""
    extra, missing = set(incoming.columns) - set(existing.columns), set(existing.columns) - set(incoming.columns)
    if extra or missing:
        raise SchemaDrift(f"extra columns {sorted(extra)}, missing columns {sorted(missing)}")
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    tie = [order] if order else [c for c in existing.columns if c not in keys]
    return latest_per(both, list(keys), ["_batch", *tie]).drop("_batch").select(*existing.columns)


def append_report(existing: DataFrame, incoming: DataFrame, *, keys=(*ID, TS)) -> DataFrame:
    """Rows in, new and overwritten, as one row."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(1))
    inc = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(known, list(keys), "left")
    return inc.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in"),
                   F.count(F.when(C("_known").isNull(), 1)).alias("rows_new"),
                   F.count("_known").alias("rows_overwritten"))


def append_files(batches) -> DataFrame:
    """S-11: union of batches that may lack each other's columns. Ordering by time is left to
    the writer: a global sort here would cost a range exchange for nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def downsample_mean(df: DataFrame, cols, *, seconds: int = 300, keys=ID, ts: str = TS) -> DataFrame:
    """S-28: means on a fixed grid."""
    w = F.window(C(ts), f"{seconds} seconds")["start"]
    return df.groupBy(*keys, w.alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])


# --- time zone and timestamp checks ----------------------------------------------------------
def localize(df: DataFrame, local: str, tz: str, *, ambiguous: str = "first", out: str = TS) -> DataFrame:
    """S-12: local wall time to UTC with a status.

    A wall time is unambiguous when exactly one UTC instant maps back to it. Candidates are
    the conversion Spark gives and its neighbours at the shifts zones use (an hour, or half of one), so no transition table has
    to be shipped. gap: no instant maps back; ambiguous: two do.
    """
    wall = C(local)
    guess = F.to_utc_timestamp(wall, tz)
    cands = [guess + F.expr(f"INTERVAL {h} MINUTES") for h in (-60, -30, 0, 30, 60)]
    hits = F.array_sort(F.filter(F.array_distinct(F.array(*cands)), lambda c: F.from_utc_timestamp(c, tz) == wall))
    df = df.withColumn("_hits", hits)
    n = F.size("_hits")
    pick = F.element_at("_hits", 1 if ambiguous == "first" else -1)
    return (df.withColumn(out, F.when(n > 0, pick))
              .withColumn("ts_status", F.when(wall.isNull(), "failed").when(n == 0, "gap")
                          .when(n > 1, "ambiguous").otherwise("ok"))
              .drop("_hits"))


TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm"]


def parse_wall_time(c, formats=TIME_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(C(c) if isinstance(c, str) else c, F.lit(f)) for f in formats])


def interval_mode(df: DataFrame, *, keys=ID, ts: str = TS, tiebreak=(), **kw) -> DataFrame:
    """S-13: most frequent positive spacing per series; the smaller one on a tie."""
    d = with_series_columns(df.select(*keys, ts, *tiebreak),
                            lambda w: {"_d": epoch(ts) - epoch(F.lag(ts).over(w))}, keys, ts, before=1,
                            tiebreak=tiebreak, **kw)
    n = d.where(C("_d") > num(0)).groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.max_by("_d", F.struct(C("_n"), -C("_d"))).alias("interval_s"))


def timestamp_profile(df: DataFrame, *, keys=ID, ts: str = TS, status: str | None = None, **kw) -> DataFrame:
    """S-13: rows, duplicates, failures by status and the inferred interval per series."""
    per_ts = df.groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("_n"),
        *([F.count(F.when(C(status) == s, 1)).alias(s) for s in ("ambiguous", "gap", "failed")] if status else []))
    out = per_ts.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(C(ts).isNotNull(), C("_n") - 1).otherwise(0)).alias("duplicates"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        *([F.sum(s).alias(s) for s in ("ambiguous", "gap", "failed")] if status else []))
    return out.join(interval_mode(df.where(C(ts).isNotNull()), keys=keys, ts=ts, **kw), list(keys), "left")


def scan_health(df: DataFrame, *, keys=ID, ts: str = TS, order: str, **kw) -> DataFrame:
    """S-14: samples, duplicate and out-of-order stamps in ingest order, median spacing, span."""
    dup = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    a = dup.groupBy(*keys).agg(F.sum("_n").alias("samples"),
                               F.sum(F.when(C(ts).isNotNull(), C("_n") - 1).otherwise(C("_n") * 0)).alias("duplicates"),
                               F.sum(F.when(C(ts).isNull(), C("_n")).otherwise(0)).alias("malformed"),
                               F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    # Ingest order stands in for time, one second per row, so a bucket holds a fixed number of rows.
    seq = df.where(C(ts).isNotNull()).withColumn("_seq", F.timestamp_micros(C(order).cast("long") * F.lit(1_000_000)))
    seq = with_series_columns(seq, lambda w: {"_back": C(ts) < F.lag(ts).over(w)}, keys, "_seq", before=1, **kw)
    back = seq.groupBy(*keys).agg(F.count(F.when(C("_back"), 1)).alias("non_monotonic"))
    med = median_delta(df.where(C(ts).isNotNull()).select(*keys, ts).distinct(), keys, ts, out="median_delta_s", **kw)
    return a.join(back, list(keys), "left").join(med, list(keys), "left")


