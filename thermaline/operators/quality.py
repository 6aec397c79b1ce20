"""Reading quality and profiles (A-19, A-20, A-23, S-15, S-34)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from thermaline.functions.roles import ID
from thermaline.functions.logic import holds, num

C = F.col
# Logger codes for "no reading", and plausible ranges per role.
SENTINELS = [999.0, 888.0, -999.0, 9999.0, -9999.0]
BOUNDS = {
    "zone_t": (40.0, 100.0), "sat": (35.0, 140.0), "mat": (20.0, 130.0), "rat": (40.0, 110.0),
    "oa_t": (-40.0, 130.0), "chw_supply_t": (32.0, 80.0), "chw_return_t": (32.0, 90.0),
    "hw_supply_t": (60.0, 220.0), "hw_return_t": (50.0, 210.0), "zone_flow": (0.0, 20000.0),
    "vav_total_flow": (0.0, 100000.0), "duct_static": (-2.0, 6.0), "chw_dp": (0.0, 50.0),
    "chw_flow": (0.0, 20000.0), "chiller_power": (0.0, 5000.0), "elec_power": (0.0, 50000.0),
    "chiller_current": (0.0, 2000.0), "clg_valve_pct": (0.0, 100.0), "htg_valve_pct": (0.0, 100.0),
    "oa_damper_pct": (0.0, 100.0), "damper_pct": (0.0, 100.0), "reheat_valve_pct": (0.0, 100.0),
    "fan_cmd": (0.0, 100.0), "chw_pump_cmd": (0.0, 100.0), "tower_fan_cmd": (0.0, 100.0),
}
STATUS_ROLES = ["fan_status", "pump_status", "chw_pump_status", "chiller_status", "compressor_status",
                "occ_mode", "loop_enabled"]
STATUS_WORDS = ["occupied", "unoccupied", "occ", "unocc", "true", "false", "on", "off", "yes", "no"]


def reason(role: Column, value: Column) -> Column:
    """Why a reading is unusable; NULL when it is fine. The first matching reason wins."""
    x = value.try_cast("double")
    lo = F.lit(None).cast("double")
    hi = lo
    for r, (a, b) in BOUNDS.items():
        lo, hi = F.when(role == r, num(a)).otherwise(lo), F.when(role == r, num(b)).otherwise(hi)
    is_status = role.isin(STATUS_ROLES)
    physical = role.rlike("flow$|power$|current$")
    return (F.when(value.isNull(), "NULL")
             .when(x.isNull() & is_status & F.lower(F.trim(value)).isin(STATUS_WORDS), F.lit(None))
             .when(x.isNull(), "NON_NUMERIC")
             .when(x.isin(SENTINELS), "SENTINEL")
             .when(is_status, F.lit(None))
             .when(physical & (x < num(0)), "IMPOSSIBLE_FOR_ROLE")
             .when(holds((x < lo) | (x > hi)), "OUT_OF_RANGE"))


def assess_quality(df: DataFrame, roles, *, keys=ID) -> DataFrame:
    """A-19: per role and reason the sample counts, valid coverage and confidence. One scan:
    roles are unpivoted and aggregated, with the per-row reason as a plain expression."""
    long = (df.select(*keys, *[C(r).cast("string").alias(r) for r in roles])
              .unpivot(list(keys), list(roles), "role", "value")
              .withColumn("reason", reason(C("role"), C("value"))))
    n, bad = F.count(F.lit(1)), F.count("reason")
    sent = F.count(F.when(C("reason") == "SENTINEL", 1))
    cov = (n - bad) / n
    return long.groupBy(*keys, "role").agg(
        n.alias("samples"), (n - bad).alias("valid_samples"),
        *[F.count(F.when(C("reason") == k, 1)).alias(k.lower()) for k in
          ("NULL", "SENTINEL", "NON_NUMERIC", "OUT_OF_RANGE", "IMPOSSIBLE_FOR_ROLE")],
        F.round(cov, 4).alias("valid_coverage"),
        F.round(F.greatest(num(0), F.least(num(1), cov * (num(1) - num(0.5) * sent / n))), 4).alias("confidence"))


def apply_normalized(df: DataFrame, roles) -> DataFrame:
    """A-20: unusable readings become NULL."""
    return df.withColumns({r: F.when(reason(F.lit(r), C(r).cast("string")).isNull(), C(r)) for r in roles})


def compare_results(a: DataFrame, b: DataFrame, *, keys=("rule_id", *ID), metric: str = "fault_hours",
                    tol: float = 0.5) -> DataFrame:
    """A-23: key-wise parity of two result sets: pass, fail, or present on one side only."""
    keys = list(keys)
    j = (a.groupBy(*keys).agg(F.sum(metric).alias("left_value"))
          .join(b.groupBy(*keys).agg(F.sum(metric).alias("right_value")), keys, "full_outer"))
    delta = F.abs(C("left_value") - C("right_value"))
    return j.withColumn("abs_delta", delta).withColumn(
        "outcome", F.when(C("right_value").isNull(), "left_only").when(C("left_value").isNull(), "right_only")
        .when(delta <= num(tol), "pass").otherwise("fail"))


def compare_summary(cmp: DataFrame, by="rule_id") -> DataFrame:
    counts = [F.count(F.when(C("outcome") == o, 1)).alias(o) for o in ("pass", "fail", "left_only", "right_only")]
    return cmp.groupBy(by).agg(*counts, F.max("abs_delta").alias("max_abs_delta"))


def column_profile(df: DataFrame, cols) -> DataFrame:
    """S-15/S-34: per text column the inferred kind, blanks, numeric and distinct counts, and
    an example. All columns come from one aggregation, unpivoted afterwards."""
    def stats(c):
        v = F.trim(C(c).cast("string"))
        blank = v.isNull() | (v == "")
        full = F.count(F.when(~blank, 1))
        numeric = F.count(F.when(~blank & v.try_cast("double").isNotNull(), 1))
        stamp = F.count(F.when(~blank & v.try_cast("timestamp").isNotNull() & v.rlike(r"\d[-/:]\d"), 1))
        words = F.count(F.when(F.lower(v).isin("true", "false", "on", "off", "yes", "no"), 1))
        kind = (F.when(full == 0, "empty").when(numeric == full, "number").when(stamp == full, "timestamp")
                 .when(words == full, "boolean").otherwise("text"))
        return F.struct(F.lit(c).alias("column"), kind.alias("kind"), F.count(F.lit(1)).alias("rows"),
                        (F.count(F.lit(1)) - full).alias("blank"), numeric.alias("numeric"),
                        F.min(F.when(~blank, v)).alias("example"))
    wide = df.agg(*[stats(c).alias(f"s{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("s.*")


def analyze_quality(df: DataFrame, cols, *, ts: str, local_time: bool = False) -> DataFrame:
    """S-34: duplicate timestamps, columns more than half empty, local-time hint."""
    dups = df.where(C(ts).isNotNull()).groupBy(ts).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(C("n") - 1), F.lit(0)).alias("n"))
    empty = column_profile(df, cols).where(C("blank") * 2 > C("rows"))
    parts = [dups.where("n > 0").select(F.lit("duplicate_timestamp").alias("issue"), F.lit(ts).alias("column"), "n"),
             empty.select(F.lit("mostly_empty").alias("issue"), "column", C("blank").alias("n"))]
    if local_time:
        fold = df.where(F.hour(ts) == 1).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        parts.append(fold.select(F.lit("ambiguous_local_time").alias("issue"), F.lit(ts).alias("column"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)
