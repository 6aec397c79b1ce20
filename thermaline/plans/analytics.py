"""Descriptive analytics over history (B-1 to B-42)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import any_of, epoch, fan_on, frac, holds, num, percent
from thermaline.functions.roles import UNOCCUPIED_TOKENS, ensure_roles
from thermaline.operators import align
from thermaline.operators.confirm import forward_dt, median_delta
from thermaline.operators.quantile import exact_median, exact_quantiles
from thermaline.operators.rules import RULES
from thermaline.operators.runner import FAULT, PASS, equipment_kind
from thermaline.operators.series import ordinal, with_series_columns

C = F.col
GAP = 900.0  # seconds; longest interval one sample may stand for


# --- proofs ----------------------------------------------------------------------------------
def cooling_on(columns) -> Column:
    """B-15: status or command first, amps (> 2) only without those, power (> 1) last."""
    have = set(columns)

    def over(names, limit):
        names = [n for n in names if n in have]
        return any_of(C(n) > num(limit) for n in names) if names else None

    for names, limit in ((("chiller_status", "compressor_status", "chiller_cmd"), 0.05),
                         (("chiller_amps",), 2.0), (("chiller_power",), 1.0)):
        out = over(names, limit)
        if out is not None:
            return out
    return F.lit(False)


# Cooling signals in order, what each proves by, and whether its limit is that of amps, of power or of a status.
PROOF_SIGNALS = (("chiller_status", "direct", "status"), ("compressor_status", "direct", "status"), ("chiller_cmd", "direct", "status"),
                   ("chiller_amps", "analog", "amps"), ("chiller_power", "analog", "power"))


def with_cooling_proof(df: DataFrame, *, amps_min: float = 5.0, power_min: float = 1.0, status_min: float = 0.05) -> DataFrame:
    """B-15: per equipment, the first cooling signal that has an on-sample; where none has, the first that has readings.

    Adds proof_role, proof_quality and cooling_on (false without a proof). The samples of every signal are counted per equipment, with
    map-side combining, and the choice joins back: one row per equipment.
    """
    d = ensure_roles(df, [r for r, _, _ in PROOF_SIGNALS])
    limit = {"status": status_min, "amps": amps_min, "power": power_min}
    on = {r: C(r) > num(limit[k]) for r, _, k in PROOF_SIGNALS}
    picks = d.groupBy(*ID).agg(*[F.count(F.when(on[r], 1)).alias(f"on_{r}") for r in on], *[F.count(r).alias(f"n_{r}") for r in on])
    quality = {r: q for r, q, _ in PROOF_SIGNALS}
    first = F.coalesce(*[F.when(C(f"on_{r}") > 0, F.lit(r)) for r in on], *[F.when(C(f"n_{r}") > 0, F.lit(r)) for r in on])
    picks = picks.select(*ID, first.alias("proof_role"))
    picks = picks.withColumn("proof_quality", F.coalesce(*[F.when(C("proof_role") == r, F.lit(q)) for r, q in quality.items()]))
    run = any_of((C("proof_role") == r) & on[r] for r in on)
    return d.join(picks, list(ID)).withColumn("cooling_on", run).select(*df.columns, "proof_role", "proof_quality", "cooling_on")


def cooling_run(df: DataFrame, **kw) -> DataFrame:
    """B-15: per equipment the chosen proof and the samples it shows cooling in."""
    return with_cooling_proof(df, **kw).groupBy(*ID).agg(
        F.max("proof_role").alias("proof_role"), F.max("proof_quality").alias("proof_quality"),
        F.count(F.when(C("cooling_on"), 1)).alias("on_samples"), F.count(F.lit(1)).alias("samples"))


def plant_on(columns) -> Column:
    """Fan, cooling or pump proof, whichever is mapped."""
    have = set(columns)
    parts = [cooling_on(columns)]
    if "fan_status" in have or "fan_cmd" in have:
        parts.append(holds(F.coalesce(*[c for n, c in (("fan_status", C("fan_status") > num(0.05)),
                                                       ("fan_cmd", frac("fan_cmd") > num(0.01))) if n in have])))
    parts += [holds(C(n) > num(0.05)) for n in ("pump_status", "chw_pump_status") if n in have]
    return reduce(lambda a, b: a | b, parts)


def cooling_eligibility(points: DataFrame) -> DataFrame:
    """B-15: confidence that a device's mechanical cooling can be proven from its points.
    `points`: equipment_id, kind in (status, command, amps, power, valve, pump, ...)."""
    kinds = F.collect_set("kind")
    primary = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ("status", "command")]))
    support = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ("amps", "power")]))
    return points.groupBy(*ID).agg(
        F.when(primary & support, "high").when(primary | support, "medium").otherwise("none").alias("confidence"),
        (primary | support).alias("eligible"))


# --- runtime ---------------------------------------------------------------------------------
def runtime_hours(df: DataFrame, on: Column, *, max_gap: float = GAP, ts: str = TS, **kw) -> DataFrame:
    """B-1: on-hours, coverage of the span and sample counts per equipment, in one pass."""
    d = with_series_columns(df.withColumn("_on", holds(on)), lambda w: {"_next": F.lead(epoch(ts)).over(w)},
                            ID, ts, after=1, **kw)
    dt = F.greatest(num(0), F.least(C("_next") - epoch(ts), num(max_gap)))
    dt = F.when(C("_next").isNotNull(), dt)
    span = F.max(epoch(ts)) - F.min(epoch(ts))
    return d.groupBy(*ID).agg(
        (F.coalesce(F.sum(F.when(C("_on"), dt)), num(0)) / num(3600)).alias("run_hours"),
        F.when(span > num(0), num(100) * F.sum(dt) / span).otherwise(num(0)).alias("coverage_pct"),
        F.count(F.lit(1)).alias("samples"), F.count(F.when(C("_on"), 1)).alias("on_samples"),
    ).where(C("samples") > 1)


def site_oat(df: DataFrame, role: str = "oa_t") -> DataFrame:
    return align.site_reading_by_time(df, role)


def runtime_weekly(df: DataFrame, on: Column, *, max_gap: float = GAP, oat: str = "oa_t", **kw) -> DataFrame:
    """B-2: run hours per equipment and week, mean site OAT while on."""
    d = with_series_columns(df.withColumn("_on", holds(on)), lambda w: {"_next": F.lead(epoch(TS)).over(w)},
                            ID, TS, after=1, **kw).where(C("_next").isNotNull())
    dt = F.greatest(num(0), F.least(C("_next") - epoch(TS), num(max_gap)))
    d = d.drop("oat_f").join(site_oat(df, oat), [SITE, TS], "left")
    return d.groupBy(*ID, F.date_format(F.date_trunc("week", TS), "yyyy-MM-dd").alias("week")).agg(
        (F.sum(F.when(C("_on"), dt).otherwise(num(0))) / num(3600)).alias("run_hours"),
        F.avg(F.when(C("_on"), C("oat_f"))).alias("avg_oat_f")).where(C("run_hours") > num(0))


# Motor signals, their kind, and the command a status makes redundant.
MOTOR_SIGNALS = {"fan_status": "fan", "fan_cmd": "fan", "return_fan": "fan", "pump_status": "pump",
                 "chw_pump_status": "pump", "chw_pump_cmd": "pump", "tower_fan_cmd": "tower"}
REDUNDANT = {"fan_cmd": "fan_status", "chw_pump_cmd": "pump_status"}


def motor_run_hours(df: DataFrame, *, poll: float = 300.0) -> DataFrame:
    """B-3: on-hours per equipment and motor signal, from one unpivoted aggregation."""
    sig = [s for s in MOTOR_SIGNALS if s in df.columns]
    long = align.wide_to_long(df, sig).withColumn("on", F.when(C("value") > num(1.5), C("value") / num(100))
                                                  .otherwise(C("value")) > num(0.05))
    kind = F.create_map(*[F.lit(x) for kv in MOTOR_SIGNALS.items() for x in kv])
    return long.groupBy(*ID, C("role").alias("signal")).agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.when(C("on"), 1)).alias("on_samples"),
        (F.count(F.when(C("on"), 1)) * num(poll) / num(3600)).alias("run_hours"),
    ).withColumn("motor_kind", F.element_at(kind, C("signal")))


def motor_run_totals(table: DataFrame) -> DataFrame:
    """Fan, pump and total hours; a status replaces the command of the same motor."""
    by_eq = Window.partitionBy(*ID)
    signals = F.collect_set("signal").over(by_eq)  # at most a handful of signals per equipment
    drop = any_of((C("signal") == c) & F.array_contains("_s", s) for c, s in REDUNDANT.items())
    t = table.withColumn("_s", signals).where(~drop)
    fan, pump = (F.coalesce(F.sum(F.when(C("motor_kind") == k, C("run_hours"))), num(0)) for k in ("fan", "pump"))
    return t.groupBy(SITE).agg(fan.alias("fan_hours"), pump.alias("pump_hours"), (fan + pump).alias("total_hours"))


COOLING_SIGNALS = ("chiller_status", "compressor_status", "chiller_cmd", "chiller_amps", "chiller_power")

# Name patterns of plant motors, first hit wins.
MOTOR_PATTERNS = [("tower", "chiller", r"tower|ct[_-]?fan"), ("pump", "chiller", r"chwp|cwp|chw_pump|cw_pump"),
                  ("pump", "boiler", r"hwp|hw_pump|boiler.*pump"), ("pump", "chiller", r"pump"),
                  ("chiller", "chiller", r"chiller|compressor"), ("fan", "air", r"supply_fan|sf[_-]|fan")]


def discover_plant_motors(points: DataFrame, *, column: str = "column") -> DataFrame:
    """B-4: motor kind and plant group of each point by its column name."""
    c, kind, group = F.lower(column), None, None
    for k, g, p in MOTOR_PATTERNS:
        kind = F.when(c.rlike(p), k) if kind is None else kind.when(c.rlike(p), k)
        group = F.when(c.rlike(p), g) if group is None else group.when(c.rlike(p), g)
    return points.withColumns({"motor_kind": kind, "plant_group": group}).where(C("motor_kind").isNotNull())


# --- sensors ---------------------------------------------------------------------------------
def _numeric_stats():
    return [F.count(F.lit(1)).alias("n"), F.count("value").alias("n_finite"), F.min("value").alias("min"),
            F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]


def long_readings(df: DataFrame, roles) -> DataFrame:
    return df.select(*ID, *[C(r).cast("double").alias(r) for r in roles]).unpivot([*ID], list(roles), "role", "value")


def sensor_health(df: DataFrame, roles, *, min_n: int = 5, eps: float = 1e-9) -> DataFrame:
    """B-5: every role's statistics from one scan and one aggregation; roles an equipment
    never reports are left out."""
    s = long_readings(df, roles).groupBy(*ID, "role").agg(*_numeric_stats()).where(C("n_finite") > 0)
    return s.withColumns({
        "coverage_pct": num(100) * C("n_finite") / C("n"), "missingness": num(1) - C("n_finite") / C("n"),
        "flatline": (C("n_finite") > min_n) & (C("std") <= num(eps))})


def sensor_stats(df: DataFrame, roles, *, fan_state: str = "all") -> DataFrame:
    """B-6."""
    on = fan_on(False)
    d = df if fan_state == "all" else df.where(on if fan_state == "on" else ~on)
    return long_readings(d, roles).groupBy(*ID, "role").agg(*_numeric_stats()).where(C("n_finite") > 0)


SETPOINT_ROLES = ["sat_sp", "zone_t_sp", "chw_supply_sp", "duct_static_sp", "min_flow_sp"]


def occupied(c: str = "occ_mode") -> Column:
    """Tri-state: a number above 0.05, else any word that is not an unoccupied token."""
    x = F.trim(C(c)).try_cast("double")
    return F.when(C(c).isNull(), F.lit(None).cast("boolean")).when(x.isNotNull(), x > num(0.05)) \
            .otherwise(~F.lower(F.trim(C(c))).isin(UNOCCUPIED_TOKENS))


def setpoints(df: DataFrame, roles=None) -> DataFrame:
    """B-7: medians while occupied, unoccupied and overall."""
    roles = [r for r in (roles or SETPOINT_ROLES) if r in df.columns]
    d = df.withColumn("_occ", occupied())
    long = d.select(*ID, "_occ", *roles).unpivot([*ID, "_occ"], roles, "role", "value")
    occ, un = F.when(C("_occ"), C("value")), F.when(~C("_occ"), C("value"))
    keys = [*ID, "role"]
    # each reading stands for all samples, and for those of its mode
    both = long.select(*keys, "value", F.explode(F.array_compact(F.array(F.lit("all"), F.when(C("_occ"), "occupied").when(~C("_occ"), "unoccupied")))).alias("mode"))
    m = exact_median(both, [*keys, "mode"], "value", out="m").groupBy(*keys).agg(
        *[F.max(F.when(C("mode") == k, C("m"))).alias(f"median_{k}") for k in ("occupied", "unoccupied", "all")])
    n = long.groupBy(*keys).agg(F.count(occ).alias("n_occupied"), F.count(un).alias("n_unoccupied"))
    return n.join(m, keys, "left").select(*keys, "median_occupied", "median_unoccupied", "median_all", "n_occupied", "n_unoccupied")


def diurnal(df: DataFrame, roles) -> DataFrame:
    """B-8."""
    d = df.withColumns({"hour": F.hour(TS), "fan_state": F.when(fan_on(False), "on").otherwise("off")})
    long = d.select(*ID, "hour", "fan_state", *roles).unpivot([*ID, "hour", "fan_state"], list(roles), "role", "value")
    return long.where(C("value").isNotNull()).groupBy(*ID, "role", "hour", "fan_state").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


# --- schedule --------------------------------------------------------------------------------
def schedule_hours(df: DataFrame, *, max_gap: float = GAP, **kw) -> DataFrame:
    """B-9: occupied, unoccupied and covered hours over the rows that report a mode."""
    d = with_series_columns(df.where(C("occ_mode").isNotNull()).withColumn("_occ", holds(occupied())),
                            lambda w: {"_next": F.lead(epoch(TS)).over(w)}, ID, TS, after=1, **kw)
    d = d.where(C("_next").isNotNull()).withColumn("dt", F.greatest(num(0), F.least(C("_next") - epoch(TS), num(max_gap))))
    h = lambda c: F.sum(c) / num(3600)
    return d.groupBy(*ID).agg(
        h(F.when(C("_occ"), C("dt")).otherwise(num(0))).alias("occupied_hours"),
        h(F.when(~C("_occ"), C("dt")).otherwise(num(0))).alias("unoccupied_hours"), h("dt").alias("coverage_hours"),
        F.count(F.when(C("_occ"), 1)).alias("occupied_samples"), F.count(F.lit(1)).alias("total_samples"))


def after_hours_fan(fan: DataFrame, occ: DataFrame, *, on=ID, max_gap: float = GAP, **kw) -> DataFrame:
    """B-10: fan-on hours while the occupancy in force is false. Before the first occupancy
    sample the first one counts. `fan`: keys, ts, fan_on; `occ`: keys, ts, occupied."""
    keys = list(on)
    f = forward_dt(fan, cap=max_gap, final=0.0, keys=keys, **kw)
    j = align.join_asof_previous(f, occ, ["occupied"], on=keys)
    first = occ.groupBy(*keys).agg(F.min_by("occupied", TS).alias("_first"))
    j = j.join(first, keys)
    state = F.coalesce(C("occupied"), C("_first"))
    return j.groupBy(*keys).agg(
        (F.sum(F.when(holds(C("fan_on")) & ~holds(state), C("dt")).otherwise(num(0))) / num(3600)).alias("after_hours_fan_h"))


# A schedule is 7 entries, Monday first: (occupied, start minute, end minute).
OFFICE_WEEK = [(True, 480, 1080)] * 5 + [(False, 0, 0)] * 2


def occupied_mask(ts: Column, week=OFFICE_WEEK, *, tz: str = "UTC") -> Column:
    """B-11: inside the weekly window in local time; an end at or before the start wraps
    over midnight within the same weekday's entry."""
    local = F.from_utc_timestamp(ts, tz)
    minute, out = F.hour(local) * 60 + F.minute(local), F.lit(False)
    for day, (occ, start, end) in enumerate(week):
        if not occ:
            continue
        inside = (minute >= start) | (minute < end) if end <= start else (minute >= start) & (minute < end)
        out = F.when(F.weekday(local) == day, inside).otherwise(out)
    return out


def hours_per_week(week=OFFICE_WEEK) -> float:
    return sum(((1440 - s + e) if e <= s else e - s) / 60.0 for occ, s, e in week if occ)


def fill_occ_mode(df: DataFrame, week=OFFICE_WEEK, *, tz: str = "UTC") -> DataFrame:
    """Attach a mode from the calendar to equipment that reports none at all."""
    mask = F.when(occupied_mask(C(TS), week, tz=tz), "occupied").otherwise("unoccupied")
    d = ensure_roles(df, ["occ_mode"])
    has = d.groupBy(*ID).agg((F.count("occ_mode") > 0).alias("_has"))
    return d.join(has, list(ID)).withColumn("occ_mode", F.when(C("_has"), C("occ_mode")).otherwise(mask)).drop("_has")


def day_type(df: DataFrame, holidays: DataFrame | None = None, *, ts: str = TS) -> DataFrame:
    """B-12: holiday before weekend before weekday. `holidays` has one `date` column."""
    base = F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")
    if holidays is None:
        return df.withColumn("day_type", base)
    h = holidays.select(C("date").alias("_d"), F.lit(True).alias("_h")).distinct()
    return (df.withColumn("_d", F.to_date(ts)).join(h, "_d", "left")
              .withColumn("day_type", F.when(C("_h"), "holiday").otherwise(base)).drop("_d", "_h"))


# --- cooling and economizers -----------------------------------------------------------------
def oat_bins(df: DataFrame, on: Column, *, devices: Column | None = None, oat: DataFrame | None = None,
             max_gap: float = GAP, width: float = 5.0, **kw) -> DataFrame:
    """B-13: run hours per OAT bin, per device, summed over devices, and with any device on.

    The any-device series has one row per building and timestamp: it is aggregated first and treated as
    one more series, so the site-wide LEAD is cut into blocks like any other.
    """
    oat = site_oat(df.where(C("oa_t").between(40.0, 110.0))) if oat is None else oat
    src = df if devices is None else df.where(devices)
    dev = src.select(*ID, TS, holds(on).alias("_on")).join(oat, [SITE, TS], "left")
    site = (dev.where(C("oat_f").isNotNull()).groupBy(SITE, TS)
               .agg(F.max("_on").alias("_on"), F.max("oat_f").alias("oat_f")).withColumn(EQ, F.lit("ANY")))

    def binned(d):
        d = with_series_columns(d, lambda w: {"_next": F.lead(epoch(TS)).over(w)}, ID, TS, after=1, **kw)
        dt = F.greatest(num(0), F.least(C("_next") - epoch(TS), num(max_gap)))
        return (d.where(C("_on") & C("oat_f").isNotNull() & C("_next").isNotNull())
                 .groupBy(*ID, (F.floor(C("oat_f") / num(width)).cast("double") * num(width)).alias("bin_lo"))
                 .agg((F.sum(dt) / num(3600)).alias("hours")))

    each = binned(dev)
    total = each.groupBy(SITE, "bin_lo").agg(F.sum("hours").alias("hours")).select(
        SITE, F.lit("ALL").alias(EQ), "bin_lo", "hours", F.lit("aggregate_device_hours").alias("series_kind"))
    return (each.withColumn("series_kind", F.lit("individual_device"))
                .unionByName(total).unionByName(binned(site).withColumn("series_kind", F.lit("aggregate_active_hours"))))


def bas_vs_web_histogram(df: DataFrame) -> DataFrame:
    """B-14: counts of the site BAS minus web difference in 1 degF steps."""
    return (align.bas_vs_web(df).groupBy(SITE, F.floor("delta_f").cast("double").alias("delta_lo"))
                 .agg(F.count(F.lit(1)).alias("n")))


def economizer_metrics(df: DataFrame, *, dt_min: float = 10.0) -> DataFrame:
    """B-16."""
    on = holds(fan_on(False))
    return df.groupBy(*ID).agg(
        F.count(F.when(on, 1)).alias("n_fan_on"),
        F.count(F.when(on & (F.abs(C("oa_t") - C("rat")) >= num(dt_min)), 1)).alias("n_identifiable"),
        F.count("oa_damper_pct").alias("n_damper")).where(C("n_fan_on") > 0)


def economizer_points(df: DataFrame, *, dt_min: float = 10.0) -> DataFrame:
    """B-17: OA fraction from temperatures and mixed-air residual against the damper."""
    d = df.where(holds(fan_on(False)) & C("oa_t").isNotNull() & C("rat").isNotNull() & C("mat").isNotNull())
    damper, d_or, d_mr = percent("oa_damper_pct"), C("oa_t") - C("rat"), C("mat") - C("rat")
    known = F.abs(d_or) >= num(dt_min)
    oa = F.greatest(num(-20), F.least(num(120), num(100) * F.try_divide(d_mr, d_or)))
    return d.select(*ID, TS, C("oa_t").alias("oat_f"), C("rat").alias("rat_f"), C("mat").alias("mat_f"),
                    damper.alias("damper_fb_pct"), d_or.alias("delta_or_f"), d_mr.alias("delta_mr_f"),
                    known.alias("identifiable"), F.when(known, oa).alias("oa_frac_pct"),
                    (C("mat") - (C("rat") + damper / num(100) * d_or)).alias("mat_resid_f"))


def economizer_top_points(df: DataFrame, *, limit: int | None = None, dt_min: float = 10.0) -> DataFrame:
    """The identifiable points first, then by time; the first `limit` if asked for."""
    p = economizer_points(df, dt_min=dt_min).orderBy(F.desc("identifiable"), TS, *ID)
    return p if limit is None else p.limit(limit)


def economizer_residuals(df: DataFrame, *, dt_min: float = 10.0) -> DataFrame:
    """Median and mean absolute mixed-air residual of the identifiable points."""
    p = economizer_points(df, dt_min=dt_min).where(C("identifiable") & C("mat_resid_f").isNotNull())
    mae = p.groupBy(*ID).agg(F.avg(F.abs("mat_resid_f")).alias("mat_resid_mae_f"))
    return exact_median(p, ID, "mat_resid_f", out="median_mat_resid_f").join(mae, list(ID))


def economizer_points_per_equipment(df: DataFrame, *, per_equipment: int, dt_min: float = 10.0, **kw) -> DataFrame:
    """Every k-th point of an equipment that has more than the report's size, k from its count."""
    p = ordinal(economizer_points(df, dt_min=dt_min), ID, TS, name="_row", total="_total", **kw)
    step = F.greatest(F.lit(1), F.floor(C("_total") / per_equipment))
    return p.where((C("_total") <= per_equipment) | ((C("_row") - 1) % step == 0)).drop("_row", "_total")


def economizer_weather_summary(df: DataFrame, *, damper_hi=0.9, damper_winter=0.25, db=(60.0, 72.0), dp_max=60.0,
                               cold=60.0, freeze=25.0, nominal: float = 300.0, **kw) -> DataFrame:
    """B-18: opportunity, compliant and missed free cooling, prohibited mechanical cooling and
    winter economizing, in hours by actual spacing, plus weather coverage."""
    t, dp = C("web_oa_t"), C("web_oa_dp")
    free = holds((t >= num(db[0])) & (t < num(db[1])) & (dp < num(dp_max)))
    damper, valve = F.coalesce(frac("oa_damper_pct"), num(0)), F.coalesce(frac("clg_valve_pct"), num(0)) > num(0.01)
    masks = {
        "opportunity_hours": free,
        "integrated_compliant_hours": free & valve & (damper >= num(damper_hi)),
        "integrated_noncompliant_hours": free & valve & (damper < num(damper_hi)),
        "prohibited_mech_hours": holds(t < num(cold)) & cooling_on(df.columns),
        "winter_economizing_hours": holds(t < num(freeze)) & (damper > num(damper_winter)),
    }
    d = df.where(equipment_kind().isin("ahu", "chiller", "heatpump"))
    per_ts = d.groupBy(*ID, TS).agg(*[F.max(holds(m)).alias(k) for k, m in masks.items()],
                                   F.count(F.when(t.isNotNull() & dp.isNotNull(), 1)).alias("_wx"),
                                   F.count(F.lit(1)).alias("_n"))
    dt = forward_dt(per_ts, nominal=nominal, **kw)
    return dt.groupBy(*ID).agg(
        *[(F.sum(F.when(C(k), C("dt")).otherwise(num(0))) / num(3600)).alias(k) for k in masks],
        (F.sum("_wx") / F.sum("_n")).alias("weather_coverage"))


# --- health matrices -------------------------------------------------------------------------
# Matrix -> (equipment kinds, None for any; faults only; flag -> rules, primary first).
MATRICES = {
    "ahu_legacy": (("ahu",), False, {"sat_dev": ("AHU-SATDEV",), "duct_high": ("AHU-DUCTHI",), "economizer": ("ECON-1", "ECON-2")}),
    "ahu_temperature": (("ahu",), False, {"sat_dev": ("AHU-SATDEV",), "mat_low": ("FC2",), "mat_high": ("FC3",),
                                          "sat_low_heating": ("FC7",), "sat_high_cooling": ("FC13-SAT-HIGH",)}),
    "ahu_pressure": (("ahu",), False, {"duct_high": ("AHU-DUCTHI",), "duct_low": ("FC1",), "fan_mismatch": ("CMD-1",),
                                       "static_trim": ("TRIM-1",)}),
    "ahu_economizer": (("ahu",), False, {"stuck_closed": ("ECON-1",), "unfavorable": ("ECON-2",), "mech_without_econ": ("ECON-3",),
                                         "low_oa_fraction": ("ECON-4",), "preheat_over": ("ECON-5",), "freeze_risk": ("ECON-6",),
                                         "not_economizing": ("ECON-7",)}),
    "chiller": (("chiller",), False, {"low_delta_t": ("CHW-1",), "dp_low": ("CHW-2",), "supply_band": ("CHW-3",),
                                      "flow_high": ("CHW-4",), "no_load": ("CHW-NOLOAD-1",), "chw_reset": ("TRIM-4",)}),
    "cooling_tower": (("cooling_tower",), False, {"approach_high": ("CW-APR-1",), "fan_energy": ("CW-FAN-1",), "cw_optimization": ("CW-OPT-1",)}),
    "boiler": (("boiler",), False, {"fc5": ("FC5",), "fc6": ("FC6",), "fc8": ("FC8",)}),
    "heat_pump": (("heatpump",), False, {"hp_1": ("HP-1",), "sat_dev": ("AHU-SATDEV",), "economizer": ("ECON-1", "ECON-2")}),
    "sensor_faults": (None, True, {"flatline": ("SV-FLATLINE",), "range": ("SV-RANGE",), "rate": ("SV-RATE",),
                                   "spike": ("SV-SPIKE",), "stale": ("SV-STALE",)}),
    "pid_hunting": (None, False, {"operating_state_hunt": ("FC4",), "control_output_hunt": ("PID-HUNT-1",)}),
}


def tri_state(status: Column, hours: Column) -> Column:
    """Skipped or not applicable is unknown, never a pass."""
    return (F.when(status.startswith("SKIPPED") | (status == "NOT_APPLICABLE_EQUIPMENT_TYPE"), F.lit(None).cast("boolean"))
             .when((status == FAULT) | (hours > num(0)), True).when(status == PASS, False))


def health_matrix(results: DataFrame, matrix: str) -> DataFrame:
    """B-21: one row per equipment, one tri-state flag and its hours per dimension."""
    kinds, faults_only, flags = MATRICES[matrix]
    ids = [r for rules in flags.values() for r in rules]
    d = results.where(C("rule_id").isin(ids))
    if kinds:
        d = d.where(equipment_kind().isin(list(kinds)))
    d = d.withColumn("_flag", tri_state(C("status"), C("fault_hours")))
    wide = d.groupBy(*ID).agg(
        *[F.max(F.when(C("rule_id") == r, C("_flag"))).alias(f"f_{r}") for r in dict.fromkeys(ids)],
        *[F.max(F.when(C("rule_id") == r, C("fault_hours"))).alias(f"h_{r}") for r in dict.fromkeys(ids)])
    out = {}
    for k, rules in flags.items():
        out[k] = F.coalesce(*[C(f"`f_{r}`") for r in rules])
        hours = F.coalesce(*[F.when(C(f"`f_{r}`").isNotNull(), C(f"`h_{r}`")) for r in rules])
        out[f"{k}_fault_h"] = F.when(out[k].isNotNull(), F.coalesce(hours, num(0)))
    wide = wide.select(*ID, *[c.alias(k) for k, c in out.items()])
    n = len(flags)
    hit = reduce(lambda a, b: a + b, [F.coalesce(C(k).cast("int"), F.lit(0)) for k in flags])
    known = reduce(lambda a, b: a + b, [C(k).isNotNull().cast("int") for k in flags])
    wide = wide.withColumns({
        "dimensions_hit": hit, "dimensions_evaluable": known,
        "total_fault_h": reduce(lambda a, b: a + b, [F.when(C(k), C(f"{k}_fault_h")).otherwise(num(0)) for k in flags])})
    wide = wide.withColumn("score_label", F.concat(
        F.when(C("dimensions_evaluable") < n, F.lit("?")).otherwise(C("dimensions_hit").cast("string")), F.lit(f"/{n}")))
    return wide.where(C("dimensions_hit") > 0) if faults_only else wide


BROKEN_BOX_RULES = ["VAV-3", "VAV-4", "VAV-5", "VAV-7", "VAV-REHEAT", "VAV-AHU-LEAVE"]


def vav_health(df: DataFrame, results: DataFrame, *, comfort=(70.0, 75.0), poll: float = 300.0) -> DataFrame:
    """B-20: comfort, full-open and broken-box dimensions per VAV; `?/3` while any is unknown."""
    hours = lambda cond: F.count(F.when(cond, 1)) * num(poll) / num(3600)
    base = df.where(C(EQ).startswith("VAV")).groupBy(*ID).agg(
        (F.count("zone_t") / F.count(F.lit(1))).alias("zone_cov"),
        (F.count("damper_pct") / F.count(F.lit(1))).alias("damper_cov"),
        hours(~C("zone_t").between(*comfort)).alias("comfort_fail_h"),
        hours(frac("damper_pct") >= num(0.975)).alias("full_open_h"),
        (F.count(F.lit(1)) * num(poll) / num(3600)).alias("span_h"))
    bad = results.where(C("rule_id").isin(BROKEN_BOX_RULES)).groupBy(*ID).agg(
        F.max(tri_state(C("status"), C("fault_hours"))).alias("_broken"),
        F.coalesce(F.sum(F.when(C("status") == FAULT, C("fault_hours"))), num(0)).alias("broken_fault_h"))
    j = base.join(bad, list(ID), "left")
    dims = {
        "poor_zone": F.when(C("zone_cov") >= num(0.01), C("comfort_fail_h") > num(0.01)),
        "rogue_damper": F.when((C("damper_cov") >= num(0.01)) & (C("span_h") >= num(20)),
                               num(100) * F.try_divide(C("full_open_h"), C("span_h")) >= num(95)),
        "broken_box": C("_broken"),  # unknown without an evaluable result
    }
    j = j.withColumns(dims)
    known = reduce(lambda a, b: a + b, [C(k).isNotNull().cast("int") for k in dims])
    hit = reduce(lambda a, b: a + b, [F.coalesce(C(k).cast("int"), F.lit(0)) for k in dims])
    return j.select(*ID, "comfort_fail_h", "full_open_h", "span_h", F.coalesce("broken_fault_h", num(0)).alias("broken_fault_h"),
                    *dims, hit.alias("dimensions_hit"),
                    F.when(known < 3, "?/3").otherwise(F.concat(hit.cast("string"), F.lit("/3"))).alias("score_label"))


# --- review ----------------------------------------------------------------------------------
def cohort_outlier(df: DataFrame, value: str, *, z: float = 2.5, out: str = "outlier") -> DataFrame:
    """Flag rows far from the mean of their building's rows; needs three rows and some spread."""
    s = df.groupBy(SITE).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"), F.count(value).alias("_n"))
    flag = (C("_n") >= 3) & (C("_sd") > num(1e-9)) & (F.abs(C(value) - C("_mu")) / C("_sd") >= num(z))
    return df.join(s, SITE).withColumn(out, holds(flag)).drop("_mu", "_sd", "_n")


def occupied_for_rank(c: str = "occ_mode") -> Column:
    x = F.trim(C(c)).try_cast("double")
    words = F.upper(F.trim(C(c))).isin("OCC", "OCCUPIED", "TRUE", "YES", "1", "1.0", "ON")
    return C(c).isNull() | F.when(x.isNotNull(), x > num(0.05)).otherwise(words)


def zone_comfort_rank(df: DataFrame, *, comfort=(70.0, 75.0), occupied_only: bool = True, z: float = 2.5) -> DataFrame:
    """B-22: share of samples outside the band, below and above counts, cohort outliers."""
    d = df.where(C("zone_t").isNotNull())
    if occupied_only and "occ_mode" in df.columns:
        d = d.where(occupied_for_rank())
    r = d.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count(F.when(C("zone_t") < num(comfort[0]), 1)).alias("n_below"),
        F.count(F.when(C("zone_t") > num(comfort[1]), 1)).alias("n_above"), F.avg("zone_t").alias("mean_zone_t"))
    r = r.withColumn("fail_pct", num(100) * (C("n_below") + C("n_above")) / C("n_samples"))
    return cohort_outlier(r, "fail_pct", z=z)


def ahu_reset_evidence(df: DataFrame) -> DataFrame:
    """B-23: coverage and range of the two resettable setpoints."""
    aggs = []
    for r in ("sat_sp", "duct_static_sp"):
        aggs += [(num(100) * F.count(r) / F.count(F.lit(1))).alias(f"{r}_coverage_pct"),
                 (F.max(r) - F.min(r)).alias(f"{r}_span"), F.count_distinct(F.round(r, 2)).alias(f"{r}_levels")]
    return df.where(equipment_kind() == "ahu").groupBy(*ID).agg(*aggs)


def timeseries(df: DataFrame, role: str, *, limit: int | None = None, **kw) -> DataFrame:
    """B-24: all readings; with a limit the first, last and every k-th of each equipment, k = ceil(n / limit)."""
    d = df.where(C(role).isNotNull()).select(*ID, TS, C(role).alias("value_f"))
    if limit is None:
        return d
    d = ordinal(d, ID, TS, name="_row", total="_total", **kw)
    k = F.expr(f"(_total + {int(limit)} - 1) div {int(limit)}")
    keep = (C("_row") == 1) | (C("_row") == C("_total")) | (C("_row") % k == 0)
    return d.where(keep).drop("_row", "_total")


def oat_scatter(df: DataFrame, role: str, *, driver: str | None = None) -> DataFrame:
    """B-25: a role against the site OAT of the same timestamp, with an optional second driver."""
    site = df.groupBy(SITE, TS).agg(F.avg("oa_t").alias("oat_f"), F.avg(driver or "oa_t").alias("driver_f"))
    out = df.select(*ID, TS, C(role).alias("y_f")).where(C("y_f").isNotNull()).join(site, [SITE, TS])
    out = out.where(C("oat_f").isNotNull())
    return out if driver else out.drop("driver_f")


def five_number(df: DataFrame, value: str, *, by=ID, z: float = 2.5, outliers: bool = True) -> DataFrame:
    """B-26/B-27: distribution per group."""
    s = df.where(C(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    s = s.join(exact_quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), list(by)).select(
        *by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")
    return cohort_outlier(s, "mean", z=z) if outliers else s


def by_mode(df: DataFrame, value: str, on: Column) -> DataFrame:
    """B-27: the distribution for all samples, and for on and off separately."""
    modes = F.array(F.lit("all"), F.when(on, F.lit("on")).otherwise(F.lit("off")))
    d = df.where(C(value).isNotNull()).select(*ID, C(value), F.explode(modes).alias("mode"))
    return five_number(d, value, by=(*ID, "mode"), outliers=False)


def inspect(df: DataFrame, equipment, columns, *, limit: int | None = None, after=None, before=None) -> DataFrame:
    """B-28: a page of raw columns; the filters reach the scan."""
    d = df.where(C(EQ).isin(list(equipment))) if equipment else df
    d = d.where(C(TS) >= F.lit(after)) if after is not None else d
    d = d.where(C(TS) <= F.lit(before)) if before is not None else d
    d = d.select(*ID, TS, *columns).orderBy(TS, *ID)
    return d if limit is None else d.limit(limit)


def descriptive_counts(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).groupBy(*ID).agg(F.count(F.lit(1)).alias("rows"))


def dataset_time_span(df: DataFrame) -> DataFrame:
    return df.groupBy(SITE).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
                  ((F.max(epoch(TS)) - F.min(epoch(TS))) / num(3600)).alias("hours"))


def readings(df: DataFrame, columns, *, hours: float = 24.0, rolling_minutes: int | None = None, limit: int | None = None, **kw) -> DataFrame:
    """B-31: the last N hours relative to the building's newest sample, with an optional trailing
    mean; thinned to about `limit` rows per equipment if a limit is given."""
    last = df.groupBy(SITE).agg(F.max(epoch(TS)).alias("_last"))
    d = df.join(last, SITE).where(epoch(TS) >= C("_last") - num(hours * 3600)).select(*ID, TS, *columns)
    if rolling_minutes:
        us = int(rolling_minutes * 60_000_000)

        def make(_w):
            w = Window.partitionBy(*ID, "_block").orderBy("_t").rangeBetween(-us, 0)
            return {f"{c}_avg": F.avg(c).over(w) for c in columns}

        d = with_series_columns(d.withColumn("_t", F.unix_micros(TS)), make, ID, TS,
                                before_seconds=rolling_minutes * 60.0, **kw).drop("_t")
    if limit is None:
        return d
    d = ordinal(d, ID, TS, name="_row", total="_total", **kw)
    k = F.greatest(F.lit(1), F.expr(f"(_total + {int(limit)} - 1) div {int(limit)}"))
    return d.where((C("_row") == 1) | (C("_row") == C("_total")) | (C("_row") % k == 0)).drop("_row", "_total")


def evidence_availability(df: DataFrame) -> DataFrame:
    """B-42: whether OAT and cooling proof exist with data."""
    have = set(df.columns)
    seen = lambda *rs: reduce(lambda a, b: a | b, [F.count(r) > 0 for r in rs if r in have] or [F.lit(False)])
    return df.groupBy(*ID).agg(seen("oa_t", "web_oa_t").alias("has_oat"),
                              seen("chiller_status", "compressor_status", "chiller_cmd", "chiller_amps", "chiller_power")
                              .alias("has_cooling_proof"), F.count(F.lit(1)).alias("rows"))


# --- metering --------------------------------------------------------------------------------
def metering_monthly(df: DataFrame, role: str, *, cooling: bool = True, base: float = 65.0) -> DataFrame:
    """B-34: mean rate per equipment and month with the month's mean OAT, energy by sample
    count at five minutes, and degree days of that mean."""
    month = F.date_format(TS, "yyyy-MM").alias("month")
    oat = df.where(C("oa_t").isNotNull()).groupBy(SITE, month).agg(F.avg("oa_t").alias("avg_oat_f"))
    m = df.where(C(role).isNotNull()).groupBy(*ID, month).agg(F.avg(role).alias("avg_rate"), F.count(F.lit(1)).alias("n_samples"))
    j = m.join(oat, [SITE, "month"], "left")
    t = F.coalesce(C("avg_oat_f"), num(65))
    gap = t - num(base) if cooling else num(base) - t
    days = F.greatest(C("n_samples") * num(5) / num(1440), num(1))
    return j.withColumns({"energy": C("avg_rate") * C("n_samples") * num(5) / num(60),
                          "degree_days": F.greatest(gap, num(0)) * days})


def integrate_rate_monthly(df: DataFrame, role: str, *, cap_factor: float = 20.0, **kw) -> DataFrame:
    """B-35: rate times hours since the previous sample, capped at 20 median spacings; the
    first sample counts one median."""
    med = median_delta(df, **kw)
    d = with_series_columns(df.select(*ID, TS, C(role).alias("rate")),
                            lambda w: {"_d": epoch(TS) - F.lag(epoch(TS)).over(w)}, ID, TS, before=1, **kw)
    d = d.join(med, list(ID), "left")
    m = F.when(C("_median") > num(0), C("_median")).otherwise(num(300))
    sec = F.greatest(num(0), F.least(F.coalesce(C("_d"), m), m * num(cap_factor)))
    return d.groupBy(*ID, F.date_format(TS, "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum(C("rate") * sec / num(3600)), num(0)).alias("energy"), F.count("rate").alias("n_samples"),
        F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate")).where(C("n_samples") > 0)


def degree_days(df: DataFrame, role: str = "oa_t", *, base: float = 65.0, by=()) -> DataFrame:
    """B-36: heating and cooling degree days per month from daily means."""
    day = df.where(C(role).isNotNull()).groupBy(*by, F.to_date(TS).alias("_day")).agg(F.avg(role).alias("_t"))
    return day.groupBy(*by, F.date_format("_day", "yyyy-MM").alias("month")).agg(
        F.sum(F.greatest(num(0), num(base) - C("_t"))).alias("hdd"),
        F.sum(F.greatest(num(0), C("_t") - num(base))).alias("cdd"), F.avg("_t").alias("mean_oat_f"))


# --- presets and exports ---------------------------------------------------------------------
# Preset -> (chart, role, equipment kinds).
PRESETS = {
    "zone_comfort_rank": ("rank", "zone_t", ("vav", "zone")), "zone_temps": ("box", "zone_t", ("vav", "zone")),
    "vav_flows": ("box", "zone_flow", ("vav",)), "vav_health_matrix": ("vav_health", None, ("vav",)),
    "ahu_sat_reset_scatter": ("scatter", "sat_sp", ("ahu",)), "ahu_dats": ("box", "sat", ("ahu",)),
    "ahu_mats": ("box", "mat", ("ahu",)), "ahu_rats": ("box", "rat", ("ahu",)),
    "ahu_dampers": ("box", "oa_damper_pct", ("ahu",)), "ahu_cooling_valves": ("box", "clg_valve_pct", ("ahu",)),
    "ahu_heating_valves": ("box", "htg_valve_pct", ("ahu",)), "fan_speeds": ("box", "fan_cmd", ("ahu",)),
    "duct_static_box": ("box", "duct_static", ("ahu",)), "duct_static_ts": ("series", "duct_static", ("ahu",)),
    "hw_reset_scatter": ("scatter", "hw_supply_t", ("boiler",)), "chw_reset_scatter": ("scatter", "chw_supply_t", ("chiller",)),
    "cw_reset_scatter": ("scatter", "cw_supply_t", ("chiller", "cooling_tower")),
    "chw_temps_ts": ("series", "chw_supply_t", ("chiller",)), "cw_temps_ts": ("series", "cw_supply_t", ("chiller", "cooling_tower")),
    "meter_elec_cdd": ("metering", "elec_power", ("meter", "chiller")), "meter_gas_hdd": ("metering_gas", "gas_flow", ("meter", "boiler")),
    "ahu_motor_weekly": ("weekly", None, ("ahu",)), "economizer_delta": ("econ", "delta_or_f", ("ahu",)),
    "economizer_mat_resid": ("econ", "mat_resid_f", ("ahu",)), "economizer_temps_overlay": ("econ", "oat_f", ("ahu",)),
    "boiler_motor_weekly": ("weekly", None, ("boiler",)), "chiller_motor_weekly": ("weekly", None, ("chiller", "cooling_tower")),
    "mech_cooling_oat_bins": ("bins", None, ("chiller", "heatpump")), "bas_vs_web_oat": ("bas_web", None, None),
}


def preset(name: str, df: DataFrame, *, results: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """B-32: a named review, routed to the operator behind it."""
    chart, role, kinds = PRESETS[name]
    d = df if kinds is None else df.where(equipment_kind().isin(list(kinds)))
    if chart == "rank":
        return zone_comfort_rank(d)
    if chart == "box":
        return five_number(d, role)
    if chart == "vav_health":
        return vav_health(d, results)
    if chart == "scatter":
        return oat_scatter(df, role).join(d.select(*ID).distinct(), list(ID), "left_semi")
    if chart == "series":
        return timeseries(d, role, limit=limit)
    if chart in ("metering", "metering_gas"):
        return metering_monthly(df, role, cooling=chart == "metering").join(d.select(*ID).distinct(), list(ID), "left_semi")
    if chart == "weekly":
        return runtime_weekly(df, plant_on(df.columns)).join(d.select(*ID).distinct(), list(ID), "left_semi")
    if chart == "econ":
        return economizer_points(d).select(*ID, TS, role)
    if chart == "bins":
        return oat_bins(df, cooling_on(df.columns), devices=equipment_kind().isin(list(kinds)))
    return align.bas_vs_web(df)


def preset_evidence(name: str, df: DataFrame) -> tuple[Column, str]:
    """Rows that a preset can show, and what it needs in words."""
    chart, role, kinds = PRESETS[name]
    have = lambda *rs: reduce(lambda a, b: a | b, [C(r).isNotNull() for r in rs if r in df.columns] or [F.lit(False)])
    need = {"vav_health": (have("zone_t", "damper_pct"), "zone or damper"), "weekly": (have(*MOTOR_SIGNALS, *COOLING_SIGNALS), "motor signal"),
            "bins": (have(*COOLING_SIGNALS), "cooling proof"), "bas_web": (have("oa_t") & have("web_oa_t"), "oa_t and web_oa_t"),
            "econ": (holds(fan_on(False)) & have("oa_t") & have("rat") & have("mat"), "oa_t, rat and mat")}
    rows, words = need.get(chart) or (have(role), role)
    return (rows & equipment_kind().isin(list(kinds)) if kinds else rows), words


def preset_coverage(df: DataFrame, names=None) -> DataFrame:
    """B-39: series and rows of every preset, and why one has nothing to show. Rows are counted per
    equipment first, so no raw row is multiplied."""
    items = [(n, *preset_evidence(n, ensure_roles(df, ["fan_status", "fan_cmd"]))) for n in (names or PRESETS)]
    per = ensure_roles(df, ["fan_status", "fan_cmd"]).groupBy(*ID).agg(*[F.count(F.when(hit, 1)).alias(f"r{i}") for i, (_, hit, _) in enumerate(items)])
    wide = per.agg(*[f.alias(f"{k}{i}") for i in range(len(items)) for k, f in (("s", F.count(F.when(C(f"r{i}") > 0, 1))), ("r", F.coalesce(F.sum(f"r{i}"), F.lit(0))))])
    rows = F.array(*[F.struct(F.lit(n).alias("preset"), C(f"s{i}").alias("series"), C(f"r{i}").alias("rows"),
                              F.when(C(f"r{i}") == 0, F.lit(f"no {words} data")).alias("reason")) for i, (n, _, words) in enumerate(items)])
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def clustering_features(df: DataFrame, roles, results: DataFrame) -> DataFrame:
    """B-38: one wide row per equipment: role statistics and fault hours per rule."""
    stats = df.groupBy(*ID).agg(*[f(r).alias(f"{r}__{n}") for r in roles for n, f in
                                 (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    faults = results.groupBy(*ID).agg(*[
        F.coalesce(F.sum(F.when(C("rule_id") == r, C("fault_hours"))), num(0)).alias(f"fault__{r.lower().replace('-', '_')}")
        for r in RULES if RULES[r].aggs is None])
    return stats.join(faults, list(ID), "left")


def analytics_dump(df: DataFrame, results: DataFrame, out: str) -> dict[str, str]:
    """B-40: four tables as CSV under `out`."""
    parts = {"vav_health": vav_health(df, results), "oat_bins": oat_bins(df, cooling_on(df.columns)),
             "motor_hours": motor_run_hours(df), "motor_weekly": runtime_weekly(df, plant_on(df.columns))}
    for name, d in parts.items():
        d.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    return {n: f"{out}/{n}" for n in parts}
