"""Per-sensor evidence: operating state, rates of change, sweeps and output hunting (V-1 to V-5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from thermaline.functions.roles import ID, TS
from thermaline.functions.logic import any_of, energized, epoch, frac, holds, num, percent
from thermaline.functions.roles import ensure_roles
from thermaline.operators import rules as R
from thermaline.operators.carry import MINUTE, Days, Reach, by_day, nearest, rolling_median
from thermaline.operators.confirm import runs, streak
from thermaline.operators.runner import role_presence
from thermaline.operators.series import BLOCK, CORE, block_window, core_rows, deal, default_rows, split_series, with_series_columns

C = F.col

STATE_ROLES = ["fan_status", "fan_cmd", "pump_status", "chw_pump_status", "chiller_status", "compressor_status",
               "chw_pump_cmd", "clg_valve_pct", "htg_valve_pct", "oa_damper_pct", "reheat_valve_pct"]


def detect_operating_state(df: DataFrame, *, transition_minutes: int = 20, **kw) -> DataFrame:
    """V-1: OFF, RUNNING_STEADY, STARTUP_TRANSIENT, SHUTDOWN_TRANSIENT or UNKNOWN_STATE.

    A start or stop colours the following minutes; a valve or damper move does so only while
    running. Equipment without any proof signal is unknown.
    """
    d = ensure_roles(df, STATE_ROLES)
    d = d.join(role_presence(d, STATE_ROLES), list(ID))
    has = lambda r: C(f"_has_{r}")
    command = lambda r: holds(frac(r) > num(0.05))
    proof = lambda r: holds(C(r) > num(0.5))
    fan = F.when(has("fan_status"), proof("fan_status")).when(has("fan_cmd"), command("fan_cmd")).otherwise(False)
    plant = [proof(r) for r in ("pump_status", "chw_pump_status", "chiller_status", "compressor_status")]
    known = any_of(has(r) for r in STATE_ROLES[:7])
    d = d.withColumns({"_known": known, "_on": fan | any_of(plant) | command("chw_pump_cmd"), "_t": F.unix_micros(TS)})
    win = int(max(1, transition_minutes)) * 60 * 1_000_000
    moves = ["clg_valve_pct", "htg_valve_pct", "oa_damper_pct", "reheat_valve_pct"]

    def make(w):
        recent = Window.partitionBy(*ID, BLOCK).orderBy("_t").rangeBetween(-win, 0)
        z = lambda r: F.coalesce(frac(r), num(0))
        was = F.lag("_on").over(w)
        return [{"_start": C("_on") & ~F.coalesce(was, F.lit(False)),
                 "_stop": ~C("_on") & F.coalesce(was, F.lit(False)),
                 "_move": any_of(F.abs(z(r) - F.lag(z(r)).over(w)) > num(0.05) for r in moves)},
                {f"_r{e}": F.max(e).over(recent) for e in ("_start", "_stop", "_move")}]

    s = with_series_columns(d, make, ID, TS, before=1, before_seconds=win / 1e6, rows=df.count(), **kw)
    state = (F.when(~C("_known"), "UNKNOWN_STATE").when(C("_r_stop"), "SHUTDOWN_TRANSIENT")
              .when(C("_r_start"), "STARTUP_TRANSIENT").when(~C("_on"), "OFF")
              .when(C("_r_move"), "STARTUP_TRANSIENT").otherwise("RUNNING_STEADY"))
    return s.select(*df.columns, state.alias("op_state"))


RATE_KEYS = (*ID, "role")


def readings(df: DataFrame, roles, *keep) -> DataFrame:
    """One row per (equipment, role, timestamp), empty readings included: a gap in the
    readings interrupts a rate."""
    return (df.select(*ID, TS, *keep, *[C(r).cast("double").alias(r) for r in roles])
              .unpivot([*ID, TS, *keep], list(roles), "role", "value"))


def split_readings(df: DataFrame, roles, *keep, before: int, **kw) -> DataFrame:
    """`readings` with blocks, see `split_series`. All roles of an equipment have the same stamps, so its rows get their blocks before
    they become one per role: neither they nor the map of the blocks are joined once per role."""
    n = df.count()
    wide = split_series(df.select(*ID, TS, *keep, *roles), ID, TS, before=before, rows=n, dealt=False, **kw)
    long = readings(wide, roles, *keep, BLOCK, CORE)
    return deal(long, [*RATE_KEYS, BLOCK], n * len(roles), kw.get("target_rows") or default_rows(long))


WINDOWS = (5, 15, 60)


def median_rows(sample_seconds: float) -> int:
    return max(3, round(15 * 60 / max(sample_seconds, 60.0)))


def _rates(t: np.ndarray, value: np.ndarray, n: int, max_gap_hours: float, windows) -> dict[str, np.ndarray]:
    """The columns of `compute_rates` of one series in order."""
    gap = np.r_[np.nan, np.diff(t) / 3.6e9]
    gap[~((gap > 0) & (gap <= max_gap_hours))] = np.nan
    step = np.abs(np.r_[np.nan, np.diff(value)]) / gap
    out = {"dt_hours": gap, "instantaneous_rate": step}
    for m in windows:
        out[f"rate_{m}min"] = np.abs(value - nearest(t, value, t - m * MINUTE, max(2, m // 2) * MINUTE)) / (m / 60.0)
    out["robust_slope_15min"] = rolling_median(step, n, 3)
    return out


def _reach(n: int, windows, held: float = 0.0) -> Reach:
    """Looking back n + 1 rows, to the edge of the widest window (and over the rows that colour an operating state)."""
    return Reach(n + 2, (max(windows) + max(2, max(windows) // 2)) * 60.0, held)


def compute_rates(long: DataFrame, *, sample_seconds: float = 300.0, max_gap_hours: float = 2.0, windows=WINDOWS) -> DataFrame:
    """V-2: absolute rate per hour between samples, against the sample nearest to 5, 15 and 60
    minutes earlier, and the rolling median of the former."""
    n = median_rows(sample_seconds)
    made = ["dt_hours", "instantaneous_rate", *[f"rate_{m}min" for m in windows], "robust_slope_15min"]
    kept = [c for c in long.columns if c != TS]
    schema = ", ".join([*[f"`{c}` {'double' if c == 'value' else long.schema[c].dataType.simpleString()}" for c in kept], "_t long", *[f"{c} double" for c in made]])

    def run(part: pd.DataFrame, days: Days) -> pd.DataFrame:
        rates = _rates(days.t, days.x["value"], n, max_gap_hours, windows)
        return part[[*kept, "_t"]].assign(**{c: v[days.own:] for c, v in rates.items()})

    out = by_day(long, ["value"], _reach(n, windows), run, schema, keys=RATE_KEYS, ts=TS)
    none = lambda c: F.when(~F.isnan(c), C(c)).alias(c)
    return out.select(*[F.timestamp_micros("_t").cast(long.schema[TS].dataType).alias(TS) if c == TS else none(c) if c == "value" else C(c) for c in long.columns],
                      *[none(c) for c in made])


# Per role the steady warning and fault, transient warning and fault rate per hour,
# persistence in minutes, largest change in 5 minutes, and the factor to the profile's unit.
IN_WC_TO_PA, PSI_TO_KPA = 249.08891, 6.894757
RATE_PROFILES = {
    "zone_t": (4.0, 6.0, 8.0, 12.0, 10, 15.0, 1.0),
    "rat": (6.0, 10.0, 12.0, 20.0, 10, None, 1.0),
    "oa_t": (12.0, 18.0, 20.0, 30.0, 10, None, 1.0),
    "mat": (12.0, 20.0, 30.0, 45.0, 10, None, 1.0),
    "sat": (10.0, 16.0, 35.0, 50.0, 10, None, 1.0),
    "heating_coil_leaving_temp": (15.0, 25.0, 50.0, 75.0, 10, None, 1.0),
    "cooling_coil_leaving_temp": (12.0, 20.0, 35.0, 50.0, 10, None, 1.0),
    "vav_discharge_t": (12.0, 20.0, 35.0, 50.0, 10, None, 1.0),
    "chw_supply_t": (6.0, 10.0, 15.0, 25.0, 10, None, 1.0),
    "chw_return_t": (8.0, 12.0, 15.0, 25.0, 10, None, 1.0),
    "hw_supply_t": (15.0, 25.0, 50.0, 75.0, 10, None, 1.0),
    "hw_return_t": (12.0, 20.0, 30.0, 50.0, 10, None, 1.0),
    "cw_supply_t": (10.0, 16.0, 20.0, 30.0, 10, None, 1.0),
    "duct_static": (0.75 * IN_WC_TO_PA, 1.25 * IN_WC_TO_PA, 3.0 * IN_WC_TO_PA, 5.0 * IN_WC_TO_PA, 10, None, IN_WC_TO_PA),
    "chw_dp": (5.0 * PSI_TO_KPA, 10.0 * PSI_TO_KPA, 20.0 * PSI_TO_KPA, 35.0 * PSI_TO_KPA, 10, None, PSI_TO_KPA),
}


def _profile(i: int) -> Column:
    out = F.lit(None).cast("double")
    for role, p in RATE_PROFILES.items():
        if p[i] is not None:
            out = F.when(C("role") == role, num(p[i])).otherwise(out)
    return out


def _states(days: Days, transition_minutes: int) -> tuple[np.ndarray, np.ndarray]:
    """(running up or down, known) of every row, as `detect_operating_state` has it; bit i of the marks: role i of STATE_ROLES has readings."""
    has = {r: bool(days.marks >> i & 1) for i, r in enumerate(STATE_ROLES)}
    share = {r: np.where(days.x[r] > 1, days.x[r] / 100, days.x[r]) for r in STATE_ROLES}
    proof = lambda r: days.x[r] > 0.5
    command = lambda r: share[r] > 0.05
    on = proof("fan_status") if has["fan_status"] else command("fan_cmd") if has["fan_cmd"] else np.zeros(len(days.t), dtype=bool)
    for r in ("pump_status", "chw_pump_status", "chiller_status", "compressor_status"):
        on = on | proof(r)
    on = on | command("chw_pump_cmd")
    was = np.r_[False, on[:-1]]
    moved = np.zeros(len(on), dtype=bool)
    for r in ("clg_valve_pct", "htg_valve_pct", "oa_damper_pct", "reheat_valve_pct"):
        moved[1:] |= np.abs(np.diff(np.nan_to_num(share[r]))) > 0.05
    since = days.t - max(1, int(transition_minutes)) * MINUTE
    first, last = np.searchsorted(days.t, since), np.searchsorted(days.t, days.t, side="right")

    def recent(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag)]
        return total[last] > total[first]

    stop, start = recent(~on & was), recent(on & ~was)
    known = any(has[r] for r in STATE_ROLES[:7])
    return (stop | start | (on & recent(moved))) & known, np.full(len(on), known)


def _held(over: np.ndarray, t: np.ndarray, nxt: int | None, seconds: float) -> tuple[np.ndarray, np.ndarray]:
    """(confirmed, start of the run) by elapsed time up to the next sample; the last sample of a series is left open."""
    begin = over & ~np.r_[False, over[:-1]]
    start = np.maximum.accumulate(np.where(begin, t, np.iinfo(np.int64).min))
    ahead = np.r_[t[1:], t[-1] if nxt is None else nxt]
    done = over & (ahead - np.where(over, start, ahead) >= int(seconds * 1e6))
    if nxt is None:
        done[-1] = False
    return done, start


_PART = ("role string, maximum_rate double, maximum_15_min_rate double, maximum_60_min_rate double, faults long, extreme boolean, violations long, "
         "hours double, first long, last long, samples long, rows long, open_from long, open_at long, open_hours double, gaps array<long>, gap_rows array<long>")


def evaluate_points(df: DataFrame, roles=None, *, poll: float = 300.0, transition_minutes: int = 20, max_gap_hours: float = 2.0,
                    persistence: float = 600.0) -> DataFrame:
    """V-3: per (equipment, role) violations of the rate limits for the operating state.

    A fault is a rate at or above the limit that persists, or one extreme jump. A single
    fault sample without an extreme counts as nothing. State, rates and persistence of all roles
    come from one pass per equipment and day; its summaries are added up per equipment.
    """
    roles = [r for r in (roles or RATE_PROFILES) if r in df.columns]
    n = median_rows(poll)
    d = ensure_roles(df, [*STATE_ROLES, *roles])
    cols = list(dict.fromkeys([*STATE_ROLES, *roles]))
    d = d.select(*ID, TS, *cols)
    bits = [F.when(C(r).isNotNull(), F.lit(1 << i)).otherwise(0) for i, r in enumerate(STATE_ROLES)]
    marks = bits[0]
    for b in bits[1:]:
        marks = marks.bitwiseOR(b)
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in ID)

    def most(v: np.ndarray) -> float:
        return float(np.nanmax(v)) if len(v) and not np.isnan(v).all() else float("nan")

    def run(part: pd.DataFrame, days: Days) -> pd.DataFrame:
        own, out = slice(days.own, None), []
        moving, _ = _states(days, transition_minutes)
        gaps, gap_rows = np.unique(np.diff(days.t[max(days.own - 1, 0):]), return_counts=True)
        for i, role in enumerate(roles):
            p = RATE_PROFILES[role]
            value = days.x[role] * p[6]
            r = _rates(days.t, value, n, max_gap_hours, WINDOWS)
            primary = np.where(np.isnan(r["robust_slope_15min"]), np.where(np.isnan(r["rate_15min"]), r["instantaneous_rate"], r["rate_15min"]), r["robust_slope_15min"])
            over = primary >= np.where(moving, p[3], p[1])
            extreme = r["rate_5min"] * (5 / 60.0) >= p[5] if p[5] is not None else np.zeros(len(over), dtype=bool)
            held, start = _held(over, days.t, days.next, persistence)
            hit, t, hours = (held | extreme)[own], days.t[own], np.nan_to_num(r["dt_hours"][own])
            undecided = days.next is None and bool(over[-1]) and not extreme[-1]
            out.append((role, most(primary[own]), most(r["rate_15min"][own]), most(r["rate_60min"][own]), int(over[own].sum()), bool(extreme[own].any()), int(hit.sum()),
                        float(hours[hit].sum()), int(t[hit][0]) if hit.any() else None, int(t[hit][-1]) if hit.any() else None, int((~np.isnan(value[own])).sum()), len(t),
                        int(start[-1]) if undecided else None, int(t[-1]) if undecided else None, float(hours[-1]), gaps if i == 0 else [], gap_rows if i == 0 else []))
        names = [c.split()[0] for c in _PART.split(", ")]
        out = pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("first", "last", "open_from", "open_at")})
        for k in ID:
            out[k] = part[k].iloc[0]
        return out[[*ID, *names]]

    parts = by_day(d, cols, _reach(n, WINDOWS, persistence), run, f"{types}, {_PART}", keys=ID, ts=TS, marks=marks)
    merged = parts.groupBy(*ID).applyInPandas(lambda rows: _merged(rows, poll, persistence), f"{types}, {_TOTAL}")
    stamp = lambda c: F.timestamp_micros(c).cast(df.schema[TS].dataType).alias(c)
    rate = lambda c: F.when(~F.isnan(c), C(c)).alias(c)
    shown = {"maximum_rate": rate, "maximum_15_min_rate": rate, "maximum_60_min_rate": rate, "first_violation": stamp, "last_violation": stamp}
    return merged.select(*[shown.get(c, C)(c) for c in merged.columns])


_TOTAL = ("role string, maximum_rate double, maximum_15_min_rate double, maximum_60_min_rate double, violation_count long, violation_minutes double, "
          "first_violation long, last_violation long, sample_count long, data_coverage double")


def _spacing(rows: pd.DataFrame) -> float | None:
    """Median of the gaps that the days have counted, in microseconds."""
    gaps, n = (np.concatenate(rows[c].to_list()) for c in ("gaps", "gap_rows"))
    if not len(gaps):
        return None
    order = np.argsort(gaps, kind="stable")
    upto = np.cumsum(n[order])
    low, high = (gaps[order][np.searchsorted(upto, k, side="right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return (low + high) / 2


def _merged(rows: pd.DataFrame, poll: float, persistence: float) -> pd.DataFrame:
    """Totals per role of one equipment from its days; the last sample of the series counts the median spacing."""
    spacing, out = _spacing(rows), []
    spacing = poll * 1e6 if spacing is None else spacing
    for role, r in rows.groupby("role", sort=False):
        count, hours, first, last = int(r["violations"].sum()), float(r["hours"].sum()), r["first"].min(), r["last"].max()
        end = r[r["open_at"].notna()]
        if len(end) and int(end["open_at"].iloc[0]) + spacing - int(end["open_from"].iloc[0]) >= persistence * 1e6:
            count, hours, last = count + 1, hours + float(end["open_hours"].iloc[0]), end["open_at"].iloc[0]
            first = last if pd.isna(first) else first
        if int(r["faults"].sum()) < 2 and not r["extreme"].any():
            count, hours, first, last = 0, 0.0, None, None
        out.append((*(rows[k].iloc[0] for k in ID), role, r["maximum_rate"].max(), r["maximum_15_min_rate"].max(), r["maximum_60_min_rate"].max(), count, hours * 60,
                    None if pd.isna(first) else int(first), None if pd.isna(last) else int(last), int(r["samples"].sum()), int(r["samples"].sum()) / int(r["rows"].sum())))
    names = [*ID, *[c.split()[0] for c in _TOTAL.split(", ")]]
    return pd.DataFrame(out, columns=names).astype({"first_violation": "Int64", "last_violation": "Int64"})


def longest_violations(flags: DataFrame, flag: str = "violation", **kw) -> DataFrame:
    """Longest run of a flag per (equipment, role)."""
    return runs(flags, C(flag), keys=RATE_KEYS, **kw).groupBy(*RATE_KEYS).agg(
        F.max(epoch("end") - epoch("start")).alias("longest_violation_s"), F.count(F.lit(1)).alias("violation_runs"))


SWEEP_RULES = ["SV-RANGE", "SV-SPIKE", "SV-FLATLINE", "SV-STALE"]
SWEEP_ROLES = list(R.SPIKE_LIMITS)


def sweep_flags(df: DataFrame, *, params: dict | None = None, poll: float = 300.0, **kw) -> DataFrame:
    """V-4, per sample and role: a raw and a confirmed flag per sensor-validation rule."""
    p = {r: R.RULES[r].settings(poll, **(params or {}).get(r, {})) for r in SWEEP_RULES}
    d = ensure_roles(df, [*SWEEP_ROLES, "fan_status", "fan_cmd", "pump_status", "chw_pump_cmd", "chiller_status"])
    scale = p["SV-RANGE"]["range_scale_temperature"]
    bounds = {r: R.RANGE_FIXED.get(r) or tuple(scale * v for v in R.RANGE_LIMITS[r]) for r in SWEEP_ROLES}

    def by_role(values: dict) -> Column:
        out = F.lit(None).cast("double")
        for role, v in values.items():
            out = F.when(C("role") == role, num(v)).otherwise(out)
        return out

    flat_n, stale_n = R._flat_rows(p["SV-FLATLINE"]), R._stale_rows(p["SV-STALE"])
    held = C("role").isin(R.HELD_ROLES)

    def make(w):
        def span(n):
            roll = w.rowsBetween(1 - n, 0)
            return F.when(F.count("value").over(roll) >= n, F.max("value").over(roll) - F.min("value").over(roll))
        return {"_step": F.abs(C("value") - F.lag("value").over(w)), "_flat": span(flat_n), "_stale": span(stale_n)}

    n = R.RULES["SV-RANGE"].confirm_rows(p["SV-RANGE"])
    lo, hi = by_role({r: b[0] for r, b in bounds.items()}), by_role({r: b[1] for r, b in bounds.items()})
    spike = by_role({r: v * p["SV-SPIKE"]["spike_scale"] for r, v in R.SPIKE_LIMITS.items()})
    flags = {
        "SV-RANGE": C("_live") & ((C("value") < lo) | (C("value") > hi)),
        "SV-SPIKE": C("_live") & (C("_step") > spike),
        "SV-FLATLINE": C("_live") & held & (C("_flat") <= num(p["SV-FLATLINE"]["flatline_tol"])),
        "SV-STALE": held & (C("_stale") <= num(p["SV-STALE"]["stale_tol"])),
    }

    def steps(w):
        return [{**make(w), "_rn": F.row_number().over(w)}, {k: holds(v) for k, v in flags.items()},
                {f"confirmed {k}": streak(C(f"`{k}`"), C("_rn"), w) >= F.lit(n) for k in flags}]

    s = split_readings(d.withColumn("_live", energized()), SWEEP_ROLES, "_live", before=max(flat_n, stale_n) + n + 1, **kw)
    for step in steps(block_window(RATE_KEYS, TS)):
        s = s.withColumns(step)
    return core_rows(s).select(*ID, TS, "role", "value", *[f"`{k}`" for k in flags], *[f"`confirmed {k}`" for k in flags])


def sweep_evidence(df: DataFrame, *, params: dict | None = None, poll: float = 300.0, **kw) -> DataFrame:
    """V-4: per equipment, role and rule the confirmed samples and hours, the range of the
    offending values and when they occurred."""
    flags = sweep_flags(df, params=params, poll=poll, **kw)
    aggs = []
    for r in SWEEP_RULES:
        hit, v = C(f"`confirmed {r}`"), F.when(C(f"`confirmed {r}`"), C("value"))
        t = F.when(hit, C(TS))
        aggs.append(F.struct(F.lit(r).alias("rule_id"), F.count(F.when(hit, 1)).alias("fault_samples"), (F.count(F.when(hit, 1)) * num(poll) / num(3600)).alias("fault_hours"),
                             F.avg(v).alias("fault_mean"), F.min(v).alias("fault_min"), F.max(v).alias("fault_max"), F.min(t).alias("first_fault"),
                             F.max(t).alias("last_fault")).alias(r))
    wide = flags.groupBy(*RATE_KEYS).agg(*aggs)
    return (wide.select(*RATE_KEYS, F.explode(F.array(*[C(f"`{r}`") for r in SWEEP_RULES])).alias("e")).select(*RATE_KEYS, "e.*")
                .where(C("fault_samples") > 0))


def sensor_fault_matrix(evidence: DataFrame) -> DataFrame:
    """B-19: hours per sensor with one column per rule."""
    return evidence.groupBy(*ID, "role").agg(
        *[F.coalesce(F.sum(F.when(C("rule_id") == r, C("fault_hours"))), num(0)).alias(r.lower().replace("-", "_"))
          for r in SWEEP_RULES], F.sum("fault_hours").alias("total_hours"))


def hunting_by_output(df: DataFrame, *, params: dict | None = None, poll: float = 300.0, **kw) -> DataFrame:
    """V-5: the hunting test on every control output, not only the first mapped one."""
    p = R.RULES["PID-HUNT-1"].settings(poll, **(params or {}))
    d = ensure_roles(df, [*R.OUTPUT_ROLES, "loop_enabled", "fan_status", "fan_cmd"])
    s = split_readings(d.withColumn("_live", R.loop_active()), R.OUTPUT_ROLES, "_live", before=R.RULES["PID-HUNT-1"].lookback(p) + 1, **kw)
    w = block_window(RATE_KEYS, TS)
    for step in R.hunting_steps(p, w, percent("value"), "_h"):
        s = s.withColumns(step)
    s = core_rows(s).withColumn("_bad", holds(C("_live") & R.hunting(p, "_h")))
    return s.groupBy(*RATE_KEYS).agg(
        F.count("value").alias("samples"), F.sum(C("_bad").cast("int")).alias("hunting_samples"),
        (F.sum(C("_bad").cast("int")) * num(poll) / num(3600)).alias("hunting_hours"),
        F.max("_h_tv").alias("max_total_variation"), F.max("_h_turns").alias("max_reversals"),
        F.max("_h_span").alias("max_span"))
