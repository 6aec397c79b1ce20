"""Registered queries: confirmation framework, alignment, ingest checks, sensors, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions import roles as roles_mod
from thermaline.functions.logic import num
from thermaline.operators import align, confirm, quality, runner, sensors, topology
from thermaline.plans.base import history, query, raw_history, rounded, stamp, weather
from thermaline.plans.store import shared_path
from thermaline.sources import csv_ingest, driver_tables as D
from thermaline.sources import history as H

C = F.col
ROLES4 = ["sat", "mat", "zone_t", "fan_cmd"]
BATCH_RULES = ["FC1", "FC2", "FC13-SAT-HIGH", "AHU-SATDEV", "AHU-SIMUL", "ECON-1", "VAV-2", "VAV-5", "VAV-6", "CHW-1",
               "CHW-3", "CW-OPT-1", "HP-1", "SV-RANGE", "TRIM-3", "MECH-OAT-1"]


def high():
    return C("value") > num(60)


# --- framework -------------------------------------------------------------------------------
@query("confirm_rows_raw")
def confirm_rows_raw(spark, d):
    c = confirm.confirm_rows(raw_history(spark, d), high(), 2, tiebreak=("event_id",))
    return c.groupBy(*ID).agg(F.count(F.when(C("confirmed"), 1)).alias("confirmed"), F.count(F.lit(1)).alias("samples"))


@query("confirm_elapsed")
def confirm_elapsed(spark, d):
    c = confirm.confirm_elapsed(raw_history(spark, d), high(), 7200.0)
    return c.groupBy(*ID).agg(F.count(F.when(C("confirmed"), 1)).alias("confirmed"))


@query("elapsed_hours")
def elapsed_hours(spark, d):
    return rounded(confirm.elapsed_hours(raw_history(spark, d), high()), 4)


@query("confirm_episodes")
def confirm_episodes(spark, d):
    e = confirm.confirm_episodes(raw_history(spark, d), high(), 1800.0)
    return rounded(e.select(*ID, stamp("start"), stamp("end"), "samples", "duration_s", C("open").cast("int").alias("open")), 3)


@query("forward_dt_hours")
def forward_dt_hours(spark, d):
    f = confirm.forward_dt(raw_history(spark, d), cap=3600.0)
    return rounded(f.groupBy(*ID).agg((F.sum("dt") / num(3600)).alias("hours"), F.max("dt").alias("longest_s")), 4)


@query("hours_under_mask")
def hours_under_mask(spark, d):
    return rounded(confirm.hours_under_mask(raw_history(spark, d), C("is_on"), cap=7200.0), 4)


@query("startup_delay")
def startup_delay(spark, d):
    s = confirm.startup_delay(history(spark, d), C("fan_status") > num(0.05), 600.0, 300.0)
    return s.groupBy(*ID).agg(F.count(F.when(C("active"), 1)).alias("active_samples"))


@query("infer_poll")
def infer_poll(spark, d):
    return rounded(confirm.infer_poll(raw_history(spark, d)), 3)


@query("confirmed_series_fc1")
def confirmed_series_fc1(spark, d):
    s = runner.rule_series(history(spark, d), "FC1")
    return rounded(s.select(*ID, stamp(TS), "duct_static", "duct_static_sp", "fan_cmd", C("raw_fault").cast("int").alias("raw_fault"),
                            C("confirmed").cast("int").alias("confirmed")))


@query("mode_stable")
def mode_stable(spark, d):
    m = runner.mode_stable(history(spark, d), 15.0)
    return m.groupBy(*ID, "op_state").agg(F.count(F.when(C("mode_stable"), 1)).alias("stable"), F.count(F.lit(1)).alias("samples"))


@query("run_batch_statuses")
def run_batch_statuses(spark, d):
    return rounded(runner.run_batch(history(spark, d), BATCH_RULES, weather=weather(spark, d)).select(
        *ID, "kind", "rule_id", "status", "fault_hours", "fault_pct", "active_samples"))


@query("rules_tuned_by_layer")
def rules_tuned_by_layer(spark, d):
    rows = [(None, None, "FC2", "confirm_seconds", 1800.0), ("B2", None, "AHU-SATDEV", "sat_dev_err", 9.0), ("B2", "AHU_1", "AHU-SATDEV", "sat_dev_err", 2.0),
            (None, None, "AHU-SATDEV", "sat_dev_err", 7.0), ("B1", None, "FC2", "confirm_seconds", 900.0)]
    tuning = spark.createDataFrame(rows, "building_id string, equipment_id string, rule_id string, name string, value double")
    return rounded(runner.run_rules(history(spark, d), ["FC2", "AHU-SATDEV", "FC1"], tuning=tuning).select(*ID, "rule_id", "status", "fault_hours"))


@query("simple_rule")
def simple_rule(spark, d):
    s = runner.simple_rule(history(spark, d), "sat", ">", 90.0)
    return s.groupBy(*ID).agg(F.count(F.when(C("fault_raw"), 1)).alias("fault_samples"))


@query("custom_rule")
def custom_rule(spark, d):
    c = runner.custom_rule(history(spark, d), "sat - sat_sp > ${margin} and fan_status > 0.5D", params={"margin": 10}, confirm_rows=3)
    return c.groupBy(*ID).agg(F.count(F.when(C("confirmed"), 1)).alias("confirmed"))


@query("custom_mask_python")
def custom_mask_python(spark, d):
    m = runner.custom_mask(history(spark, d), lambda pdf: (pdf["sat"] > 90) & (pdf["fan_cmd"].fillna(0) > 10), ["sat", "fan_cmd"], before=0)
    return m.groupBy(*ID).agg(F.count(F.when(C("fault_raw"), 1)).alias("fault_samples"))


@query("rolling_zscore")
def rolling_zscore(spark, d):
    z = runner.rolling_zscore(history(spark, d), "elec_power", rows=12, limit=2.0)
    return rounded(z.groupBy(*ID).agg(F.count(F.when(C("fault_raw"), 1)).alias("fault_samples"), F.max("zscore").alias("max_z")), 4)


@query("assess_quality")
def assess_quality(spark, d):
    return quality.assess_quality(history(spark, d), ["zone_t", "oa_t", "hw_supply_t", "chw_return_t", "fan_cmd", "damper_pct", "occ_mode"])


@query("apply_normalized")
def apply_normalized(spark, d):
    n = quality.apply_normalized(history(spark, d), ["hw_supply_t", "damper_pct", "chw_return_t"])
    return n.groupBy(*ID).agg(*[F.count(r).alias(f"n_{r}") for r in ("hw_supply_t", "damper_pct", "chw_return_t")])


@query("compare_results")
def compare_results(spark, d):
    h = history(spark, d)
    runs = [runner.run_rules(h, ["FC1", "AHU-SATDEV", "VAV-5"], params={"AHU-SATDEV": {"sat_dev_err": e}}).select(
        *ID, "rule_id", "fault_hours") for e in (5.0, 9.0)]
    return rounded(quality.compare_summary(quality.compare_results(*runs)))


# --- alignment -------------------------------------------------------------------------------
def _sides(spark, d):
    h = raw_history(spark, d)
    left = h.where(C("event_type") == "view").select(*ID, TS, "event_id", C("value").alias("left_value"))
    right = h.where(C("event_type") == "purchase").select(*ID, TS, C("value").alias("right_value"))
    return left, right


@query("join_exact_hour")
def join_exact_hour(spark, d):
    left, right = _sides(spark, d)
    hour = lambda x: x.withColumns({"raw_ts": C(TS), TS: F.date_trunc("hour", TS)})
    j = align.join_exact(hour(left), hour(right), ["right_value"], on=ID, right_order=("raw_ts",))
    return rounded(j.select("event_id", "left_value", "right_value"))


@query("join_asof_previous")
def join_asof_previous(spark, d):
    left, right = _sides(spark, d)
    return rounded(align.join_asof_previous(left, right, ["right_value"], on=ID).select("event_id", "left_value", "right_value"))


@query("join_floor_hour")
def join_floor_hour(spark, d):
    left, right = _sides(spark, d)
    j = align.join_floor_hour(left, right.drop(EQ), ["right_value"], on=[SITE])
    return rounded(j.select("event_id", "left_value", "right_value"))


@query("join_weather_15m")
def join_weather_15m(spark, d):
    left, _ = _sides(spark, d)
    w = weather(spark, d).select(SITE, TS, "oa_t", "oa_h")
    return rounded(align.join_weather_15m(left, w, ["oa_t", "oa_h"], on=[SITE]).select("event_id", "oa_t", "oa_h"))


@query("resample_kw_hourly")
def resample_kw_hourly(spark, d):
    left, _ = _sides(spark, d)
    w = weather(spark, d).select(SITE, TS, "oa_t")
    j = align.join_resampled_hourly(left.select(SITE, TS, "left_value"), w, ["left_value"], ["oa_t"], on=[SITE])
    return rounded(j.select(SITE, stamp(TS), F.round("left_value", 3).alias("left_value"), "oa_t"))


def _gappy(spark, d):
    return raw_history(spark, d).withColumn("reading", F.when(C("event_type").isin("view", "click"), C("value")))


def _fill(policy):
    def run(spark, d):
        f = align.apply_fill(_gappy(spark, d), policy, ["reading"], tiebreak=("event_id",))
        return rounded(f.select("event_id", "reading", C("fill_created").cast("int").alias("fill_created")), 3)
    return run


for _p in ("forward", "backward", "linear", "constant"):
    query(f"fill_{_p}")(_fill(_p))


@query("site_oat_by_ts")
def site_oat_by_ts(spark, d):
    h = history(spark, d)
    j = h.join(align.site_reading_by_time(h, "oa_t"), [SITE, TS], "left")
    return rounded(j.groupBy(*ID).agg(F.avg(C("oa_t") - C("oat_f")).alias("mean_offset"), F.count("oat_f").alias("n")))


@query("site_oat_with_fallback")
def site_oat_with_fallback(spark, d):
    return rounded(align.site_oat_with_fallback(history(spark, d)).select(SITE, stamp(TS), "oat_f"))


@query("weather_equi_join")
def weather_equi_join(spark, d):
    j = runner.attach_weather(history(spark, d), weather(spark, d))
    return rounded(j.groupBy(*ID).agg(F.avg("wx_oa_t").alias("mean_wx"), F.count("wx_web_oa_t").alias("n_web")))


# --- shape, ingest checks --------------------------------------------------------------------
@query("wide_to_long")
def wide_to_long(spark, d):
    l = align.wide_to_long(history(spark, d), ROLES4)
    return rounded(l.groupBy(*ID, "role").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("long_to_wide")
def long_to_wide(spark, d):
    h = raw_history(spark, d).withColumns({"role": C("event_type"), TS: F.date_trunc("hour", TS)})
    w = align.long_to_wide(h, ["view", "click", "purchase"], order="event_id")
    return rounded(w.select(*ID, stamp(TS), "view", "click", "purchase"))


def _batches(spark, d):
    h = raw_history(spark, d).withColumn(TS, F.date_trunc("day", TS)).select(*ID, TS, "value", "event_id", "event_type")
    new = h.where(C("event_type").isin("purchase", "error")).withColumn("value", C("value") * num(2))
    return h.where(~C("event_type").isin("purchase", "error")), new


@query("append_merge")
def append_merge(spark, d):
    m = align.append_merge(*_batches(spark, d), order="event_id")
    return rounded(m.select(*ID, stamp(TS), "value", "event_id"))


@query("append_report")
def append_report(spark, d):
    return align.append_report(*_batches(spark, d))


@query("append_files")
def append_files(spark, d):
    a, b = _batches(spark, d)
    u = align.append_files([a, b.drop("event_type")])
    return rounded(u.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.count("event_type").alias("typed"), F.sum("value").alias("total")), 4)


@query("downsample_mean")
def downsample_mean(spark, d):
    m = align.downsample_mean(raw_history(spark, d), ["value"], seconds=21600)
    return rounded(m.select(*ID, stamp(TS), "value"))


@query("metric_to_imperial")
def metric_to_imperial(spark, d):
    m = roles_mod.metric_to_imperial(history(spark, d).select(*ID, TS, "oa_t", "duct_static", "zone_flow", "chw_dp"))
    return rounded(m.groupBy(*ID).agg(*[F.avg(c).alias(c) for c in ("oa_t", "duct_static", "zone_flow", "chw_dp")]))


@query("timestamp_profile")
def timestamp_profile(spark, d):
    h = raw_history(spark, d).withColumn(TS, F.date_trunc("hour", TS))
    p = align.timestamp_profile(h)
    return rounded(p.select(*ID, "n_rows", "duplicates", stamp("first_ts"), stamp("last_ts"), "interval_s"))


@query("scan_health")
def scan_health(spark, d):
    h = D.table(spark, d, "orders").select((C("o_custkey") % 2).cast("string").alias(SITE), F.expr("cast(o_custkey % 50 div 2 as string)").alias(EQ), C("o_orderdate").cast("timestamp").alias(TS),
                                           "o_orderkey")
    s = align.scan_health(h, order="o_orderkey")
    return rounded(s.select(*ID, "samples", "duplicates", "malformed", "non_monotonic", "median_delta_s", stamp("first_ts"), stamp("last_ts")))


@query("localize_dst")
def localize_dst(spark, d):
    # Order dates span several springs and autumns; minutes come from the key.
    o = D.table(spark, d, "orders").select(C("o_orderkey"), F.timestamp_seconds(
        F.unix_timestamp(C("o_orderdate").cast("timestamp")) + (C("o_orderkey") % 240) * 60).alias("wall"))
    l = align.localize(o, "wall", "America/Chicago")
    return l.groupBy("ts_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_timestamp(TS) - F.unix_timestamp("wall")).alias("shift_s"))


@query("column_profile")
def column_profile(spark, d):
    h = history(spark, d).select("occ_mode", C("zone_t").cast("string").alias("zone_t"), C(EQ))
    return quality.column_profile(h, ["occ_mode", EQ]).select("column", "kind", "rows", "blank", "numeric", "example")


@query("csv_quarantine")
def csv_quarantine(spark, d):
    """All events as CSV packages with damaged lines, read back: records by status, and whether each file is numbered without gaps."""
    e = D.table(spark, d, "events").withColumn("unit", F.concat(F.lit("U"), C("user_id") % 8))
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(C("event_type") == "error", F.lit("")).otherwise(F.lit("Z"))
    root = shared_path(spark, "csv")
    (e.select("unit", F.when(C("event_id") % 10 > 0, F.concat(wall, zone)).alias(TS), C("value").alias("sat"),
              F.when(C("event_type") == "signup", F.lit('5" duct')).otherwise(C("event_type")).alias("mode"))
      .write.partitionBy("unit").option("header", True).csv(root))
    unit = F.concat(F.lit("unit="), C("unit"))
    roles = e.select(unit.alias(EQ)).distinct().select(EQ, F.explode(F.array(F.lit("sat"), F.lit("mode"))).alias("column")).withColumn("role", C("column"))
    rows = csv_ingest.read_wide_rows(spark, root, ["sat", "mode"], name="*.csv", role_map=roles)
    at = C("source_row_number")
    files = rows.groupBy("source_file").agg(((F.max(at) == F.count(at)) & (F.sum(at) * 2 == F.count(at) * (F.count(at) + 1))).alias("whole"))
    by = rows.join(files, "source_file").groupBy(F.substring(EQ, 6, 9).alias("unit"), "parse_status")
    return rounded(by.agg(F.count(at).alias("n"), F.sum("sat").alias("total"), F.count("mode").alias("modes"), F.every("whole").alias("numbered")), 4)


@query("analyze_quality")
def analyze_quality(spark, d):
    h = raw_history(spark, d).withColumns({TS: F.date_trunc("hour", TS), "note": F.when(C("event_type") == "view", C("event_type"))})
    return quality.analyze_quality(h, ["note", "event_type"], ts=TS, local_time=True)


@query("ingest_quality_gate")
def ingest_quality_gate(spark, d):
    h = raw_history(spark, d).withColumns({
        TS: F.when(C("event_type") != "error", F.date_trunc("hour", TS)), "value": F.when(C("event_type") != "signup", C("value"))})
    g = H.ingest_quality_gate(h)
    return g.select("check", "n", C("blocks").cast("int").alias("blocks"))


@query("audit_package")
def audit_package(spark, d):
    def package(building):
        h = history(spark, d).where(C(SITE) == building)
        mapped = h.select(*ID).distinct().select(*ID, F.explode(F.array(F.lit("sat"), F.lit("steam_flow"))).alias("role"))
        feeds = topology.infer_parent(h.where(runner.equipment_kind() == "vav"), h.where(runner.equipment_kind() == "ahu"))
        return H.audit_package(h, mapped, trusted_start="2024-01-02 00:00:00", feeds=feeds).withColumn(SITE, F.lit(building))

    a = package("B1").unionByName(package("B2"))
    return rounded(a.select(SITE, "absent_roles", "before_trusted", "feed_coverage_pct", "vavs_without_ahu", "stale_feeds", "grade"))


@query("validate_building")
def validate_building(spark, d):
    h = history(spark, d)
    mapped = align.wide_to_long(h, ["fan_cmd", "sat"]).select(*ID, "role").distinct().where(C(EQ) != "METER_1")
    v = H.validate_building(h, mapped)
    return v.select(*ID, "rows", "role_count", F.concat_ws(",", "missing").alias("missing"), "verdict")


@query("export_history")
def export_history(spark, d):
    e = H.export_rows(history(spark, d), ["sat", "mat"], tz="America/Chicago")
    return rounded(e)


@query("page_of_rows")
def page_of_rows(spark, d):
    return rounded(H.page(raw_history(spark, d).select(*ID, "event_id", "value"), ["event_id"], offset=40, limit=25))


@query("sql_over_views")
def sql_over_views(spark, d):
    q = ("WITH hot AS (SELECT building_id, equipment_id, sat FROM history WHERE sat > :lim) "
         "SELECT building_id, equipment_id, COUNT(*) AS n, ROUND(AVG(sat), 6) AS mean_sat FROM hot GROUP BY building_id, equipment_id")
    return H.run_sql(spark, q, {"history": history(spark, d)}, {"lim": 80.0})


@query("rules_without_weather")
def rules_without_weather(spark, d):
    """Rules that read the weather table, without one: equipment that has no readings of its own is skipped, not passed."""
    own = {r: F.when(~C(EQ).startswith("AHU_1"), C(r)) for r in ("web_oa_t", "web_oa_dp")}
    r = runner.run_rules(history(spark, d).withColumns(own), ["OAT-METEO", "ECON-3", "ECON-6", "ECON-7"])
    return rounded(r.select(*ID, "rule_id", "status", "fault_hours"))


# --- sensors ---------------------------------------------------------------------------------
@query("operating_state")
def operating_state(spark, d):
    return sensors.detect_operating_state(history(spark, d)).groupBy(*ID, "op_state").agg(F.count(F.lit(1)).alias("n"))


@query("compute_rates")
def compute_rates(spark, d):
    r = sensors.compute_rates(sensors.readings(history(spark, d), ["sat", "zone_t"]))
    return rounded(r.groupBy(*ID, "role").agg(*[F.sum(c).alias(c) for c in (
        "instantaneous_rate", "rate_5min", "rate_15min", "rate_60min", "robust_slope_15min")]), 3)


@query("evaluate_points")
def evaluate_points(spark, d):
    e = sensors.evaluate_points(history(spark, d), ["zone_t", "sat", "duct_static"])
    return rounded(e.select(*ID, "role", "maximum_rate", "violation_count", "violation_minutes", "sample_count", "data_coverage",
                            stamp("first_violation"), stamp("last_violation")), 4)


@query("sweep_evidence")
def sweep_evidence(spark, d):
    e = sensors.sweep_evidence(history(spark, d))
    return rounded(e.select(*ID, "role", "rule_id", "fault_samples", "fault_hours", "fault_min", "fault_max", "fault_mean",
                            stamp("first_fault"), stamp("last_fault")))


@query("sensor_fault_matrix")
def sensor_fault_matrix(spark, d):
    return rounded(sensors.sensor_fault_matrix(sensors.sweep_evidence(history(spark, d))))


@query("hunting_by_output")
def hunting_by_output(spark, d):
    return rounded(sensors.hunting_by_output(history(spark, d)), 4)


# --- topology --------------------------------------------------------------------------------
def _feeds(spark, d):
    h = history(spark, d)
    return topology.infer_parent(h.where(runner.equipment_kind() == "vav"), h.where(runner.equipment_kind() == "ahu"))


@query("infer_parent")
def infer_parent(spark, d):
    return _feeds(spark, d)


@query("attach_parent_sat")
def attach_parent_sat(spark, d):
    j = topology.attach_parent_sat(history(spark, d), _feeds(spark, d))
    j = j.where(C(EQ).startswith("VAV"))
    return rounded(j.groupBy(*ID).agg(F.avg("ahu_sat").alias("mean_parent_sat"), F.count("ahu_sat").alias("n")))


@query("load_satisfaction")
def load_satisfaction(spark, d):
    s = topology.load_satisfaction(history(spark, d), comfort=(60.0, 85.0), sat_band=40.0)
    return s.select(SITE, stamp(TS), C("zones_ok").cast("int").alias("zones_ok"), C("ahus_ok").cast("int").alias("ahus_ok"))


@query("chw_noload_from_topology")
def chw_noload_from_topology(spark, d):
    h = topology.attach_load_satisfaction(history(spark, d), comfort=(60.0, 85.0), sat_band=40.0)
    return rounded(runner.run_rule(h.where(runner.equipment_kind() == "chiller"), "CHW-NOLOAD-1"))


@query("invert_feeds")
def invert_feeds(spark, d):
    i = topology.invert_feeds(_feeds(spark, d))
    return i.select(SITE, "parent_ahu", F.concat_ws(",", "children").alias("children"), "child_count")


def _model(spark, d):
    n = D.table(spark, d, "nation").join(D.table(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    equip = n.select(F.concat(F.lit("N"), C("n_nationkey").cast("string")).alias("equip_id"), C("r_name").alias("equip_type"),
                     C("r_name").alias("site_ref"), C("n_name").alias("label"))
    seg = lambda s: F.when(C("c_mktsegment") == s, C("c_name"))
    points = D.table(spark, d, "customer").select(
        C("c_custkey").alias("point_id"), C("c_name").alias("name"),
        F.when(C("c_acctbal") >= 0, F.concat(F.lit("N"), C("c_nationkey").cast("string"))).alias("equip_ref"),
        seg("AUTOMOBILE").alias("csv_ref"), seg("BUILDING").alias("bacnet_ref"), seg("MACHINERY").alias("modbus_ref"),
        seg("FURNITURE").alias("fdd_input"))
    edges = n.select(F.concat(F.lit("N"), C("n_regionkey").cast("string")).alias("src"),
                     F.concat(F.lit("N"), C("n_nationkey").cast("string")).alias("dst"))
    return equip, points, edges


@query("model_coverage")
def model_coverage(spark, d):
    e, p, _ = _model(spark, d)
    return topology.model_coverage(p, e)


@query("source_coverage")
def source_coverage(spark, d):
    return topology.source_coverage(_model(spark, d)[1])


@query("unmapped_points")
def unmapped_points(spark, d):
    return topology.unmapped_points(_model(spark, d)[1])


@query("points_by_equipment")
def points_by_equipment(spark, d):
    return topology.points_by_equipment(_model(spark, d)[1])


@query("equipment_summary")
def equipment_summary(spark, d):
    return topology.equipment_summary(_model(spark, d)[0])


@query("feeds_edges")
def feeds_edges(spark, d):
    e, _, g = _model(spark, d)
    return topology.feeds_edges(g, e)


@query("list_by_site")
def list_by_site(spark, d):
    e, p, _ = _model(spark, d)
    return topology.list_by_site(e, p)


@query("role_map_gap")
def role_map_gap(spark, d):
    from thermaline.operators.rules import RULES
    h = history(spark, d)
    mapped = align.wide_to_long(h, ["sat", "mat", "rat", "oa_t", "fan_cmd", "zone_t", "damper_pct", "zone_flow", "chw_supply_t"])
    mapped = mapped.select(*ID, "role").distinct().withColumn("kind", runner.equipment_kind())
    rules = spark.createDataFrame([(i, k, list(r.required)) for i, r in RULES.items() if r.required for k in r.kinds],
                                  "rule_id string, kind string, required array<string>")
    g = topology.role_map_gap(mapped, rules).where(C("missing_count") > 0)
    return g.select(*ID, "rule_id", F.concat_ws(",", "missing").alias("missing"), "missing_count")


PART_PATTERNS = [("sat", ["small ring", "ring"]), ("fan_cmd", ["gear"]), ("zone_t", ["widget", "gizmo"]), ("mat", ["red", "blue"])]


@query("suggest_roles")
def suggest_roles(spark, d):
    s = topology.suggest_roles(D.table(spark, d, "part"), PART_PATTERNS, key="p_partkey", column="p_name")
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"))


def _named_parts(spark, d):
    prefix = F.when(C("p_size") % 3 == 0, F.lit("DAT_Y ")).when(C("p_size") % 3 == 1, F.lit("dat_x ")).otherwise(F.lit(""))
    return D.table(spark, d, "part").withColumn("column", F.concat(prefix, "p_name"))


@query("suggest_columns")
def suggest_columns(spark, d):
    return topology.suggest_columns(_named_parts(spark, d), PART_PATTERNS, keys=["p_type", "p_brand"], column="column")


@query("suggest_unmapped")
def suggest_unmapped(spark, d):
    return topology.suggest_unmapped(_named_parts(spark, d), PART_PATTERNS, keys=["p_type", "p_brand"], column="column")


@query("resolve_roles")
def resolve_roles(spark, d):
    names = ["Discharge-Air-Temp", "fan speed", "OAT", "zn_t", "ChWS_T", "steam_flow", "sat"]
    p = D.table(spark, d, "part").withColumn("point_role", F.element_at(F.array(*[F.lit(n) for n in names]),
                                                                       (C("p_partkey") % len(names)).cast("int") + 1))
    return topology.resolve_roles(p).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("pick_best_column")
def pick_best_column(spark, d):
    cols = ["dat_x_1", "discharge_air_temp_f", "dat_y", "DAT_2"]
    p = D.table(spark, d, "part").select(
        F.expr("concat('B', p_partkey % 2 + 1)").alias(SITE), C("p_brand").alias(EQ), F.lit("sat").alias("role"),
        F.concat(F.element_at(F.array(*[F.lit(c) for c in cols]), (C("p_size") % 4).cast("int") + 1),
                 F.when(C("p_size") % 4 == 1, "").otherwise(F.concat(F.lit("_"), C("p_size").cast("string")))).alias("column"))
    return topology.pick_best_column(p.distinct())


