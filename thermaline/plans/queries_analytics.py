"""Registered queries: descriptive analytics, fuel and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions import weather as wx
from thermaline.functions.logic import fan_on, holds, num
from thermaline.operators import align, runner
from thermaline.operators.quantile import exact_median
from thermaline.plans import analytics as A, findings as X, fuel as U
from thermaline.plans.base import history, materialize, query, raw_history, rounded, stamp, weather
from thermaline.sources import driver_tables as D

C = F.col
HEALTH_ROLES = ["sat", "mat", "zone_t", "chw_supply_t", "chiller_power", "clg_available"]


# --- runtime and sensors ---------------------------------------------------------------------
@query("runtime_hours")
def runtime_hours(spark, d):
    h = history(spark, d)
    return rounded(A.runtime_hours(h, A.plant_on(h.columns)))


@query("runtime_hours_irregular")
def runtime_hours_irregular(spark, d):
    return rounded(A.runtime_hours(raw_history(spark, d), C("is_on"), max_gap=7200.0), 4)


@query("runtime_weekly")
def runtime_weekly(spark, d):
    h = history(spark, d)
    return rounded(A.runtime_weekly(h, A.plant_on(h.columns)))


@query("motor_run_hours")
def motor_run_hours(spark, d):
    return rounded(A.motor_run_hours(history(spark, d)))


@query("motor_run_totals")
def motor_run_totals(spark, d):
    return rounded(A.motor_run_totals(A.motor_run_hours(history(spark, d))))


@query("discover_plant_motors")
def discover_plant_motors(spark, d):
    names = ["CHWP_1_status", "HWP-2 cmd", "supply_fan_speed", "cooling_tower_fan", "zone_temp", "compressor_1"]
    p = D.table(spark, d, "part").withColumn("column", F.element_at(F.array(*[F.lit(n) for n in names]), (C("p_partkey") % 6).cast("int") + 1))
    return A.discover_plant_motors(p).groupBy("motor_kind", "plant_group").agg(F.count(F.lit(1)).alias("n"))


@query("sensor_health")
def sensor_health(spark, d):
    s = A.sensor_health(history(spark, d), HEALTH_ROLES)
    return rounded(s.withColumn("flatline", C("flatline").cast("int")))


@query("sensor_stats_fan_on")
def sensor_stats_fan_on(spark, d):
    return rounded(A.sensor_stats(history(spark, d), HEALTH_ROLES, fan_state="on"))


@query("setpoints")
def setpoints(spark, d):
    return rounded(A.setpoints(history(spark, d), ["sat_sp", "duct_static_sp", "min_flow_sp"]))


@query("diurnal")
def diurnal(spark, d):
    return rounded(A.diurnal(history(spark, d), ["sat", "zone_t"]))


# --- schedule --------------------------------------------------------------------------------
@query("schedule_hours")
def schedule_hours(spark, d):
    return rounded(A.schedule_hours(history(spark, d)))


@query("after_hours_fan")
def after_hours_fan(spark, d):
    h = history(spark, d)
    occ = h.where(C("occ_mode").isNotNull()).select(*ID, TS, A.occupied().alias("occupied"))
    return rounded(A.after_hours_fan(h.select(*ID, TS, holds(fan_on(False)).alias("fan_on")), occ))


@query("occupied_mask")
def occupied_mask(spark, d):
    week = [(True, 420, 1080)] * 4 + [(True, 1200, 300), (False, 0, 0), (True, 540, 720)]
    h = raw_history(spark, d).withColumn("occ", A.occupied_mask(C(TS), week, tz="America/Chicago"))
    return h.groupBy(*ID).agg(F.count(F.when(C("occ"), 1)).alias("occupied"), F.count(F.lit(1)).alias("samples"))


@query("day_type")
def day_type(spark, d):
    hol = D.table(spark, d, "orders").where(C("o_totalprice") > 450000).select(F.to_date("o_orderdate").alias("date"))
    li = D.table(spark, d, "lineitem").select(C("l_shipdate").cast("timestamp").alias(TS), "l_quantity")
    return rounded(A.day_type(li, hol).groupBy("day_type").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")))


# --- cooling, economizers --------------------------------------------------------------------
@query("oat_bins")
def oat_bins(spark, d):
    h = history(spark, d)
    return rounded(A.oat_bins(h, A.cooling_on(h.columns), devices=runner.equipment_kind().isin("chiller", "heatpump")))


@query("oat_bins_weather_first")
def oat_bins_weather_first(spark, d):
    h = history(spark, d)
    return rounded(A.oat_bins(h, A.cooling_on(h.columns), oat=align.site_oat_with_fallback(h)))


@query("bas_vs_web")
def bas_vs_web(spark, d):
    return rounded(align.bas_vs_web(history(spark, d)).select(SITE, stamp(TS), "bas_oat_f", "web_oat_f", "delta_f"))


@query("bas_vs_web_histogram")
def bas_vs_web_histogram(spark, d):
    return A.bas_vs_web_histogram(history(spark, d))


@query("economizer_metrics")
def economizer_metrics(spark, d):
    return A.economizer_metrics(history(spark, d))


@query("economizer_points")
def economizer_points(spark, d):
    p = A.economizer_points(history(spark, d))
    return rounded(p.withColumns({TS: F.date_format(TS, "yyyy-MM-dd HH:mm:ss"), "identifiable": C("identifiable").cast("int")}))


@query("economizer_top_points")
def economizer_top_points(spark, d):
    p = A.economizer_top_points(history(spark, d), limit=200)
    return rounded(p.select(*ID, stamp(TS), "oat_f", "rat_f", "mat_f"))


@query("economizer_residuals")
def economizer_residuals(spark, d):
    return rounded(A.economizer_residuals(history(spark, d)))


@query("economizer_points_per_equipment")
def economizer_points_per_equipment(spark, d):
    p = A.economizer_points_per_equipment(history(spark, d), per_equipment=60)
    return rounded(p.select(*ID, stamp(TS), "delta_or_f"))


@query("economizer_weather_summary")
def economizer_weather_summary(spark, d):
    return rounded(A.economizer_weather_summary(history(spark, d)))


# --- health, review --------------------------------------------------------------------------


def _results(spark, d, rules):
    return runner.run_rules(history(spark, d), rules, weather=weather(spark, d))


def _matrix(name):
    rules = [r for rs in A.MATRICES[name][2].values() for r in rs]

    def run(spark, d):
        m = A.health_matrix(_results(spark, d, rules), name)
        return rounded(m.select(*[C(c).cast("int").alias(c) if t == "boolean" else C(c) for c, t in m.dtypes]))
    return run


for _m in A.MATRICES:
    query(f"health_{_m}")(_matrix(_m))


@query("vav_health")
def vav_health(spark, d):
    v = A.vav_health(history(spark, d), _results(spark, d, A.BROKEN_BOX_RULES))
    return rounded(v.select(*[C(c).cast("int").alias(c) if t == "boolean" else C(c) for c, t in v.dtypes]))


@query("zone_comfort_rank")
def zone_comfort_rank(spark, d):
    z = A.zone_comfort_rank(history(spark, d), z=1.2)
    return rounded(z.withColumn("outlier", C("outlier").cast("int")))


@query("ahu_reset_evidence")
def ahu_reset_evidence(spark, d):
    return rounded(A.ahu_reset_evidence(history(spark, d)))


@query("timeseries_thinned")
def timeseries_thinned(spark, d):
    return rounded(A.timeseries(history(spark, d), "zone_t", limit=50).select(*ID, stamp(TS), "value_f"))


@query("oat_scatter")
def oat_scatter(spark, d):
    s = A.oat_scatter(history(spark, d), "sat_sp", driver="web_oa_t")
    return rounded(s.select(*ID, stamp(TS), "y_f", "oat_f", "driver_f"))


@query("five_number")
def five_number(spark, d):
    f = A.five_number(history(spark, d), "zone_t", z=1.5)
    return rounded(f.withColumn("outlier", C("outlier").cast("int")))


@query("by_fan_mode")
def by_fan_mode(spark, d):
    return rounded(A.by_mode(history(spark, d), "duct_static", holds(fan_on(False))))


@query("inspect_page")
def inspect_page(spark, d):
    p = A.inspect(history(spark, d), None, ["sat", "mat"], limit=100, after="2024-01-01 06:00:00")
    return rounded(p.select(*ID, stamp(TS), "sat", "mat"))


@query("descriptive_counts")
def descriptive_counts(spark, d):
    return A.descriptive_counts(history(spark, d), C("zone_t") > num(70))


@query("dataset_time_span")
def dataset_time_span(spark, d):
    return rounded(A.dataset_time_span(raw_history(spark, d)).select(SITE, stamp("first_ts"), stamp("last_ts"), "hours"))


@query("readings_window")
def readings_window(spark, d):
    r = A.readings(history(spark, d), ["sat"], hours=12.0, rolling_minutes=30, limit=40)
    return rounded(r.select(*ID, stamp(TS), "sat", "sat_avg"))


@query("evidence_availability")
def evidence_availability(spark, d):
    e = A.evidence_availability(history(spark, d))
    return e.select(*ID, C("has_oat").cast("int").alias("has_oat"), C("has_cooling_proof").cast("int").alias("has_cooling_proof"), "rows")


@query("cooling_run_proof")
def cooling_run_proof(spark, d):
    """Air handlers with idle status signals are proven by amps, the others by the first signal that they have."""
    idle = lambda r: F.when(C(EQ).startswith("AHU") & C(r).isNotNull(), num(0)).otherwise(C(r))
    h = history(spark, d).withColumns({r: idle(r) for r in ("chiller_status", "compressor_status", "chiller_cmd")})
    return A.cooling_run(h.withColumn("chiller_amps", F.when(~C(EQ).startswith("HEATPUMP"), C("chiller_amps"))))


@query("cooling_eligibility")
def cooling_eligibility(spark, d):
    kind = (F.when(C("p_type") == "ECONOMY", "status").when(C("p_type") == "SMALL", "amps").when(C("p_type") == "MEDIUM", "power")
             .when(C("p_type") == "PROMO", "valve").otherwise("pump"))
    p = D.table(spark, d, "part").select(F.expr("concat('B', p_partkey % 2 + 1)").alias(SITE), F.concat_ws("_", "p_brand", (C("p_size") % 7).cast("string")).alias(EQ), kind.alias("kind"))
    e = A.cooling_eligibility(p)
    return e.withColumn("eligible", C("eligible").cast("int"))


@query("metering_monthly")
def metering_monthly(spark, d):
    return rounded(A.metering_monthly(history(spark, d), "elec_power"), 4)


@query("integrate_rate_monthly")
def integrate_rate_monthly(spark, d):
    return rounded(A.integrate_rate_monthly(raw_history(spark, d), "value", cap_factor=3.0), 3)


def _degree_days(spark, d):
    li = D.table(spark, d, "lineitem").select(C("l_shipdate").cast("timestamp").alias(TS), (C("l_quantity") + num(40)).alias("oa_t"))
    return A.degree_days(li)


@query("degree_days")
def degree_days(spark, d):
    return rounded(_degree_days(spark, d), 4)


@query("psychrometrics")
def psychrometrics(spark, d):
    h = history(spark, d).where(C("oa_h").between(5, 99))
    w = wx.humidity_ratio("oa_t", C("oa_h") / num(100))
    return rounded(h.groupBy(*ID).agg(F.avg(wx.dew_point_f("oa_t", "oa_h")).alias("dew_point_f"), F.avg(wx.wet_bulb_f("oa_t", "oa_h")).alias("wet_bulb_f"),
                                     F.avg(wx.enthalpy_btu_lb("oa_t", w)).alias("enthalpy_btu_lb")))


@query("merge_weather")
def merge_weather(spark, d):
    w = weather(spark, d).withColumn("web_oa_h", C("oa_h"))
    m = wx.merge_weather(history(spark, d).drop("web_wb_t"), w)
    return rounded(m.groupBy(*ID, "oa_t_source").agg(F.count(F.lit(1)).alias("n"), F.avg("oa_t_effective").alias("mean_oat"),
                                                   F.avg("web_oa_dp").alias("mean_dp"), F.avg("web_wb_t").alias("mean_wb")))


@query("weather_source_metrics")
def weather_source_metrics(spark, d):
    return rounded(wx.weather_source_metrics(history(spark, d)))


@query("clustering_features")
def clustering_features(spark, d):
    f = A.clustering_features(history(spark, d), ["sat", "zone_t"], _results(spark, d, ["FC1", "VAV-5"]))
    return rounded(f.select(*ID, *[f"{r}__{s}" for r in ("sat", "zone_t") for s in ("mean", "std", "min", "max")], "fault__fc1", "fault__vav_5"))


@query("preset_coverage")
def preset_coverage(spark, d):
    return A.preset_coverage(history(spark, d))


@query("preset_zone_temps")
def preset_zone_temps(spark, d):
    return rounded(A.preset("zone_temps", history(spark, d)).drop("outlier"))


# --- fuel ------------------------------------------------------------------------------------
def _fuel(spark, d):
    o = D.table(spark, d, "orders").join(D.table(spark, d, "customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey"))
    bills = o.groupBy(F.concat(F.lit("M"), C("c_nationkey").cast("string")).alias("meter_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum("o_totalprice").alias("usage"), F.sum(F.when(C("o_orderstatus") != "P", C("o_totalprice") * num(0.1))).alias("cost_usd"),
        F.max(C("o_totalprice") / num(1000)).alias("demand_kw"))
    n = D.table(spark, d, "nation")
    b = lambda k: F.concat(F.lit("B"), k.cast("string"))
    meters = n.select(F.concat(F.lit("M"), C("n_nationkey").cast("string")).alias("meter_id"),
                      F.when(C("n_nationkey") % 2 == 0, "electricity").otherwise("gas").alias("fuel"),
                      F.when(C("n_nationkey") % 2 == 0, "kWh").otherwise("Mcf").alias("unit"),
                      F.when(C("n_nationkey") % 3 == 0, F.array(b(C("n_nationkey")), b((C("n_nationkey") + 1) % 25)))
                       .otherwise(F.array(b(C("n_nationkey")))).alias("serves"))
    kinds = ["Office", "school", "Retail", "hotel", "Observatory"]
    buildings = n.select(b(C("n_nationkey")).alias("building_id"), (num(10000) + C("n_nationkey") * num(1000)).alias("floor_area_ft2"),
                         F.element_at(F.array(*[F.lit(k) for k in kinds]), C("n_regionkey") + 1).alias("property_type"))
    return bills, meters, buildings


@query("fuel_complete_window")
def fuel_complete_window(spark, d):
    return U.complete_windows(_fuel(spark, d)[0])


def _annual(method):
    def run(spark, d):
        a = U.annual_summary(*_fuel(spark, d), allocation=method)
        cost = [F.round(c, 1).alias(c) for c in ("elec_cost_usd", "gas_cost_usd")]
        return rounded(a.select("building_id", "kwh", "mcf", *cost, "kwh_per_ft2", "site_eui_kbtu_ft2"), 3)
    return run


for _a in ("area_weighted", "equal", "gas_share"):
    query(f"fuel_annual_{_a}")(_annual(_a))


@query("fuel_campus")
def fuel_campus(spark, d):
    return rounded(U.campus_summary(U.annual_summary(*_fuel(spark, d))), 2)


@query("fuel_monthly_gaps")
def fuel_monthly_gaps(spark, d):
    b, m, _ = _fuel(spark, d)
    b = b.where(C("usage") > num(200000))
    return rounded(U.fuel_monthly(b, m, gap_fill=True).select("meter_id", "month", "fuel", "usage", "kbtu", C("gap").cast("int").alias("gap")), 2)


@query("fuel_stacked")
def fuel_stacked(spark, d):
    b, m, _ = _fuel(spark, d)
    return rounded(U.fuel_stacked(b, m), 2)


@query("fuel_intensity")
def fuel_intensity(spark, d):
    return rounded(U.fuel_intensity(*_fuel(spark, d)).select("month", "year", "mon", "fuel", "kbtu", "intensity_kbtu_ft2"), 2)


@query("fuel_demand_grid")
def fuel_demand_grid(spark, d):
    b, m, _ = _fuel(spark, d)
    return rounded(U.demand_grid(U.fuel_demand(b, m)))


@query("fuel_quality")
def fuel_quality(spark, d):
    b, m, _ = _fuel(spark, d)
    q = U.fuel_quality(b.where(C("usage") > num(300000)), m)
    return rounded(q.select("meter_id", "n_months", "span_start", "span_end", "expected_months",
                            F.concat_ws(",", "missing_months").alias("missing_months"), "completeness_pct", "cost_coverage_pct"))


@query("fuel_weather_fit")
def fuel_weather_fit(spark, d):
    b, m, _ = _fuel(spark, d)
    return rounded(U.fuel_weather(b, m, _degree_days(spark, d)), 4)


@query("fuel_peer_band")
def fuel_peer_band(spark, d):
    a = U.annual_summary(*_fuel(spark, d)).withColumn("site_eui_kbtu_ft2", C("site_eui_kbtu_ft2") / num(20000))
    return rounded(U.compare_eui(a).select("building_id", "peer_type", "matched", "band", "vs_median_pct"), 3)


@query("tidy_bills")
def tidy_bills(spark, d):
    o = D.table(spark, d, "orders")
    raw = o.select(C("o_orderpriority").alias("account"), F.date_format("o_orderdate", "yyyyMM").alias("Bill Month"),
                   F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("kWh Total"),
                   F.when(C("o_orderstatus") != "P", C("o_totalprice")).cast("string").alias("Total Current Charges ($)"),
                   (C("o_orderkey") % 100).cast("string").alias("Billed Demand (kW)"))
    return rounded(U.tidy_bills(raw, by=("account",)), 2)


@query("weather_bins")
def weather_bins(spark, d):
    return rounded(U.weather_bins(weather(spark, d), hours_per_sample=300 / 3600))


def _measures(spark, d):
    s = D.table(spark, d, "supplier")
    k = C("s_suppkey")
    return s, k


@query("schedule_savings")
def schedule_savings(spark, d):
    s, k = _measures(spark, d)
    m = s.select(k.alias("measure_id"), (num(5) + k % 7).cast("double").alias("fan_kw"), (num(1013.7193) + k * num(11.3137)).alias("oa_cfm"),
                 num(0.8).alias("boiler_efficiency"), num(0.9).alias("kw_per_ton"), *[num(v).alias(c) for c, v in (
                     ("s1", 4.0), ("s2", 8.0), ("s3", 6.0), ("days", 7.0), ("p1", 2.0), ("p2", 8.0), ("p3", 3.0))],
                 (num(5) + k % 3).cast("double").alias("pdays"), num(55).alias("balance_f"), num(23.2).alias("supply_enthalpy"))
    return rounded(U.schedule_savings(U.weather_bins(weather(spark, d), hours_per_sample=300 / 3600), m), 4)


@query("measure_savings")
def measure_savings(spark, d):
    s, k = _measures(spark, d)
    kinds = ["fan_affinity", "schedule_reduction", "boiler_efficiency_improvement", "kw_per_ton_improvement", "outside_air_sensible",
             "outside_air_total_cooling", "economizer_runtime_cap", "chws_reset_proxy", "condenser_water_proxy"]
    m = s.select(k.alias("measure_id"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 9).cast("int") + 1).alias("kind"),
                 F.when(k % 2 == 0, "natural_gas").otherwise("electric").alias("fuel"), F.abs("s_acctbal").alias("cost"),
                 num(0.12).alias("usd_per_kwh"), num(0.9).alias("usd_per_therm"), (num(100) + k).alias("a"), (num(10) + k % 5).cast("double").alias("b"),
                 num(0.9).alias("c"), num(0.7).alias("d"), num(3).alias("e"), num(2).alias("f"))
    return rounded(U.measure_savings(m).select("measure_id", "savings_kwh", "savings_therms", "savings_usd", "payback_years", "npv_usd"), 4)


# --- findings --------------------------------------------------------------------------------
F_RULES = ["FC1", "FC2", "AHU-SATDEV", "VAV-4", "VAV-5", "VAV-AHU-LEAVE", "CHW-1", "CHW-3", "SV-RANGE", "AHU-DUCTHI", "HP-1"]


def _flags(spark, d):
    return runner.confirmed_series(history(spark, d), "AHU-SATDEV", columns=("sat", "sat_sp"))


def _records(spark, d, clears=None):
    r = _results(spark, d, F_RULES)
    sev = F.when(C("rule_id").startswith("CHW"), "critical").when(C("rule_id").startswith("VAV"), "info").otherwise("warning")
    r = r.withColumns({"raw_samples": C("fault_samples"), "severity": sev})
    return X.fault_records(r, clears, now=F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("fault_summary")
def fault_summary(spark, d):
    return X.fault_summary(_records(spark, d))


def _lifecycle(spark, d):
    """Three evaluations: all faults open, VAV-5 snoozed everywhere, and snoozes ended at every tenth box."""
    r = _results(spark, d, F_RULES)
    sev = F.when(C("rule_id").startswith("CHW"), "critical").when(C("rule_id").startswith("VAV"), "info").otherwise("warning")
    r = r.withColumns({"raw_samples": C("fault_samples"), "severity": sev})
    eq = history(spark, d).where(runner.equipment_kind() == "vav").select(*ID).distinct()
    clears = eq.select(F.concat_ws("|", *ID, F.lit("VAV-5")).alias("fault_id"), F.when(C(EQ).endswith("1"), F.lit("2024-01-15 00:00:00"))
                       .otherwise("2024-03-01 00:00:00").cast("timestamp").alias("snooze_until"))
    at = lambda day: F.lit(f"2024-{day} 00:00:00").cast("timestamp")
    r = materialize(r)
    state = X.update_lifecycle(spark.createDataFrame([], X.LIFECYCLE), r, now=at("01-10"))
    state = X.update_lifecycle(materialize(state), r, now=at("01-12"), clears=clears)
    return X.update_lifecycle(materialize(state), r, now=at("02-01"), clears=clears)


@query("fault_lifecycle")
def fault_lifecycle(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _lifecycle(spark, d).select("fault_id", "episode", "status", "severity", day("opened_at"), day("last_seen_at"), day("cleared_at"), "cleared_by")


@query("fault_lifecycle_summary")
def fault_lifecycle_summary(spark, d):
    return X.fault_summary(_lifecycle(spark, d))


@query("fault_records_cleared")
def fault_records_cleared(spark, d):
    eq = history(spark, d).where(runner.equipment_kind() == "vav").select(*ID).distinct()
    clears = eq.select(F.concat_ws("|", *ID, F.lit("VAV-5")).alias("fault_id"), F.when(C(EQ).endswith("1"), F.lit("2024-01-15 00:00:00"))
                       .otherwise("2024-03-01 00:00:00").cast("timestamp").alias("snooze_until"))
    return _records(spark, d, clears).select("fault_id", "status", "severity")


@query("fault_trend")
def fault_trend(spark, d):
    return X.fault_trend(_flags(spark, d))


@query("top_faulted")
def top_faulted(spark, d):
    return X.top_faulted(_records(spark, d), k=10)


@query("fault_families")
def fault_families(spark, d):
    return X.fault_families(_records(spark, d))


@query("stats_in_and_out_of_fault")
def stats_in_and_out_of_fault(spark, d):
    return rounded(X.stats_in_and_out_of_fault(_flags(spark, d), "sat"))


@query("fault_intervals")
def fault_intervals(spark, d):
    i = X.sparse_intervals(_flags(spark, d))
    return i.select(*ID, stamp("start"), stamp("end"), "samples", C("open").cast("int").alias("open"))


@query("worst_fault_day")
def worst_fault_day(spark, d):
    return X.worst_fault_day(_flags(spark, d))


def _candidates(spark, d):
    # Scoring reads the results several times, so they are written once, as the product does.
    r = materialize(_results(spark, d, F_RULES))
    return X.candidates(r.withColumn("fault_pct", num(100) * C("fault_samples") / C("samples")))


@query("finding_candidates")
def finding_candidates(spark, d):
    return rounded(_candidates(spark, d).select("candidate_key", "system", "fault_hours", "fault_pct", "peer_count", "fleet_size"))


def _assessed(spark, d):
    h = history(spark, d)
    comfort = h.groupBy(*ID).agg(F.avg("zone_t").alias("mean_zone_t"), F.lit(False).alias("outlier"))
    spot = h.groupBy(*ID).agg(F.min("damper_pct").alias("damper_pct"), F.max("zone_flow").alias("airflow"))
    on = holds(fan_on(False))
    static = exact_median(h.withColumn("on", on), [*ID, "on"], "duct_static", out="m").groupBy(*ID).agg(
        F.max(F.when(~C("on"), C("m"))).alias("fan_off_p50"), F.max(F.when(C("on"), C("m"))).alias("fan_on_p50"))
    return materialize(X.assess(_candidates(spark, d), comfort=comfort, spot=spot, static=static))


@query("finding_scores")
def finding_scores(spark, d):
    return rounded(_assessed(spark, d).select("candidate_key", "score", "classification", C("common_mode").cast("int").alias("common_mode")))


@query("finding_clusters")
def finding_clusters(spark, d):
    return rounded(X.clusters(_assessed(spark, d)))


@query("finding_priority")
def finding_priority(spark, d):
    return rounded(X.prioritize(_assessed(spark, d), k=7).select(SITE, "priority", "cluster", "score", "classification", "members"))


@query("fault_inventory")
def fault_inventory(spark, d):
    a = _assessed(spark, d)
    i = X.fault_inventory(a, X.prioritize(a, k=7))
    return rounded(X.inventory_rollup(i))


@query("finding_scope")
def finding_scope(spark, d):
    return X.scope_filter(_candidates(spark, d), systems=["VAV", "CHW"], exclude_rules=["SV-RANGE"]).select("candidate_key", "system")


@query("results_listing")
def results_listing(spark, d):
    r = X.results_listing(_results(spark, d, F_RULES))
    return X.status_counts(r, "rule_id", "equipment_kinds", "confirm_seconds")


@query("top_fault_rules")
def top_fault_rules(spark, d):
    return rounded(X.top_fault_hours(_results(spark, d, F_RULES), "rule_id", k=5))


def _tuned(spark, d):
    return runner.run_rules(history(spark, d), F_RULES, params={"FC2": {"confirm_seconds": 3600.0}, "CHW-3": {"sp_band": 6.0}})


@query("tuning_delta")
def tuning_delta(spark, d):
    return X.tuning_delta(_results(spark, d, F_RULES), _tuned(spark, d))


@query("tuning_hints")
def tuning_hints(spark, d):
    h = X.tuning_hints(_results(spark, d, ["SV-STALE", "SV-FLATLINE", "FC1", "VAV-5"]))
    return h.withColumn("stale_dominates", C("stale_dominates").cast("int"))


