"""Equipment topology and model coverage (T-1 to T-7, S-6 to S-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import holds, num
from thermaline.functions.scalars import with_scalars
from thermaline.operators.runner import equipment_kind

C = F.col


def infer_parent(vavs: DataFrame, ahus: DataFrame, *, scope=(SITE,)) -> DataFrame:
    """T-1: the first AHU (by id) whose id occurs inside the VAV id, else the scope's only AHU.

    "Occurs inside" becomes an equi-join: every substring of the short VAV id is a candidate
    key, so no pair of ids is compared that does not match.
    """
    scope = list(scope)
    up = F.upper(EQ)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(up)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(up) - i + F.lit(1)), lambda n: F.substring(up, i, n))))
    v = vavs.select(*scope, EQ).distinct()
    a = ahus.select(*scope, C(EQ).alias("ahu_id"), up.alias("_k")).distinct()
    hits = (v.select(*scope, EQ, F.explode(F.array_distinct(pieces)).alias("_k"))
             .join(a, [*scope, "_k"]).groupBy(*scope, EQ).agg(F.min("ahu_id").alias("_hit")))
    only = a.groupBy(*scope).agg(F.min("ahu_id").alias("_one"), F.count_distinct("ahu_id").alias("_n"))
    return (v.join(only, scope, "left").join(hits, [*scope, EQ], "left")
              .select(*scope, EQ, F.coalesce(C("_hit"), F.when(C("_n") == 1, C("_one"))).alias("parent_ahu")))


def attach_parent_sat(history: DataFrame, feeds: DataFrame, *, sat: str = "sat") -> DataFrame:
    """T-2: the parent AHU's discharge temperature on each VAV row, at the same timestamp.
    `feeds`: equipment_id, parent_ahu."""
    f = feeds.where(C("parent_ahu").isNotNull()).select(*ID, "parent_ahu")
    src = history.groupBy(SITE, C(EQ).alias("parent_ahu"), TS).agg(F.max(sat).alias("_parent_sat"))
    rows, own = history, F.lit(None).cast("double")
    if "ahu_sat" in history.columns:
        rows, own = history.withColumnRenamed("ahu_sat", "_own"), C("_own")
    return (rows.join(f, list(ID), "left").join(src, [SITE, "parent_ahu", TS], "left")
                .withColumn("ahu_sat", F.coalesce(C("_parent_sat"), own)).drop("_parent_sat", "_own"))


def load_satisfaction(history: DataFrame, *, comfort=(70.0, 75.0), sat_band: float = 2.0,
                      kind: Column | None = None) -> DataFrame:
    """T-3: per building and timestamp, whether every zone with a reading is in the comfort band and every
    AHU with both readings is within the band of its setpoint; NULL without evidence."""
    k = equipment_kind() if kind is None else kind
    lo, hi = min(comfort), max(comfort)
    zone = k.isin("vav", "zone") & C("zone_t").isNotNull()
    air = (k == "ahu") & C("sat").isNotNull() & C("sat_sp").isNotNull()
    return history.groupBy(SITE, TS).agg(
        F.min(F.when(zone, C("zone_t").between(lo, hi))).alias("zones_ok"),
        F.min(F.when(air, F.abs(C("sat") - C("sat_sp")) <= num(abs(sat_band)))).alias("ahus_ok"))


def attach_load_satisfaction(history: DataFrame, **kw) -> DataFrame:
    """Put the building flags on chiller rows, replacing what they carried."""
    flags = load_satisfaction(history, **kw)
    is_chiller = equipment_kind() == "chiller"
    names = {"building_zone_load_satisfied": "zones_ok", "building_ahu_load_satisfied": "ahus_ok"}
    out = history.join(flags, [SITE, TS], "left")
    # A column exists for the whole site as soon as any contributor does; without a valid
    # sample at a timestamp the flag is "not satisfied", never satisfied.
    return out.withColumns({
        c: F.when(is_chiller, F.when(C(f).isNull(), num(0)).otherwise(C(f).cast("double")))
            .otherwise(C(c) if c in history.columns else F.lit(None).cast("double"))
        for c, f in names.items()}).drop("zones_ok", "ahus_ok")


def invert_feeds(feeds: DataFrame, *, parent: str = "parent_ahu") -> DataFrame:
    """T-4: children per parent. A parent feeds tens of boxes; the list is per parent only."""
    return (feeds.where(C(parent).isNotNull() & C(EQ).isNotNull()).select(SITE, parent, EQ).distinct()
                 .groupBy(SITE, parent).agg(F.array_sort(F.collect_list(EQ)).alias("children"),
                                      F.count(F.lit(1)).alias("child_count")))


# --- equipment-point model -------------------------------------------------------------------
# Points carry: point_id, name, equip_ref, site_ref and the references csv_ref, bacnet_ref,
# modbus_ref, fdd_input, any of which maps the point.
REFS = [("csv_ref", "csv"), ("bacnet_ref", "bacnet"), ("modbus_ref", "modbus"), ("fdd_input", "json_api")]


def is_mapped() -> Column:
    return F.coalesce(*[F.when(C(r).isNotNull(), True) for r, _ in REFS], F.lit(False))


def model_coverage(points: DataFrame, equipment: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    mapped = F.count(F.when(is_mapped(), 1))
    one = points.agg(n.alias("point_count"), mapped.alias("mapped_points"),
                     F.round(F.coalesce(F.try_divide(mapped * num(100), n), num(0)), 1).alias("model_score"))
    one = one.withColumn("unmapped_points", C("point_count") - C("mapped_points"))
    return with_scalars(one, equipment.agg(F.count_distinct("equip_id").alias("equipment_count")))


def source_coverage(points: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(C(r).isNotNull(), F.lit(p)) for r, p in REFS], F.lit("unmapped"))
    return points.groupBy(label.alias("protocol")).agg(F.count(F.lit(1)).alias("point_count"))


def unmapped_points(points: DataFrame) -> DataFrame:
    return points.where(~is_mapped()).select("point_id", "name", "equip_ref")


def points_by_equipment(points: DataFrame) -> DataFrame:
    """Counts per equipment; the points themselves stay rows of `points`."""
    return points.groupBy(F.coalesce("equip_ref", F.lit("unassigned")).alias("equip_ref")).agg(
        F.count(F.lit(1)).alias("point_count"), F.count(F.when(is_mapped(), 1)).alias("mapped_count"))


def equipment_summary(equipment: DataFrame) -> DataFrame:
    return equipment.groupBy("equip_type").agg(F.count_distinct("equip_id").alias("equipment_count"))


def feeds_edges(edges: DataFrame, equipment: DataFrame, *, site: str | None = None) -> DataFrame:
    """T-6: edges with labels of both ends, optionally of one site."""
    eq = equipment if site is None else equipment.where(C("site_ref") == site)
    a = eq.select(C("equip_id").alias("src"), C("label").alias("src_label"))
    b = eq.select(C("equip_id").alias("dst"), C("label").alias("dst_label"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "src_label", "dst_label")


def list_by_site(equipment: DataFrame, points: DataFrame) -> DataFrame:
    per = points.groupBy(C("equip_ref").alias("equip_id")).agg(F.count(F.lit(1)).alias("point_count"))
    return (equipment.join(per, "equip_id", "left").groupBy("site_ref")
                     .agg(F.count_distinct("equip_id").alias("equipment_count"),
                          F.coalesce(F.sum("point_count"), F.lit(0)).alias("point_count")))


def role_map_gap(mapped: DataFrame, rules: DataFrame) -> DataFrame:
    """T-7: per equipment and applicable rule the required roles it lacks.
    `mapped`: equipment_id, kind, role; `rules`: rule_id, kind, required (array)."""
    have = mapped.groupBy(*ID, "kind").agg(F.collect_set("role").alias("have"))
    return (have.join(rules, "kind")
                .withColumn("missing", F.array_sort(F.array_except("required", "have")))
                .select(*ID, "kind", "rule_id", "missing", F.size("missing").alias("missing_count")))


def candidate_columns(gaps: DataFrame, columns: DataFrame, *, limit: int | None = None) -> DataFrame:
    """T-7: for each missing role the columns of the same equipment that look like it.
    5 points for the whole role name inside the column name, 1 per token."""
    need = gaps.select(*ID, F.explode("missing").alias("role")).distinct()
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_]", "")
    role = F.regexp_replace(C("role"), "_pct", "")
    tokens = F.filter(F.split(role, "_"), lambda t: t != "")
    j = need.join(columns.select(*ID, "column").distinct(), list(ID))
    score = (F.when(plain("column").contains(F.regexp_replace(role, "_", "")), 5).otherwise(0)
             + F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.when(plain("column").contains(t), 1).otherwise(0)))
    w = Window.partitionBy(*ID, "role").orderBy(F.desc("score"), "column")
    ranked = j.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(C("rank") <= limit)


# --- role naming (S-6 to S-8) ----------------------------------------------------------------
# Vendor and tagging names of each role.
ROLE_ALIASES = {
    "oa_t": ["oat", "outside_air_temp", "outside_air_temp_f", "weather_oat", "oa_temp", "bas_outside_air_temp"],
    "zone_t": ["zone_temp", "zone_temperature", "space_temp", "zn_t", "zone_air_temp"],
    "sat": ["supply_air_temp", "supply_air_temperature", "discharge_air_temp", "discharge_air_temp_f"],
    "rat": ["return_air_temp", "return_air_temp_f", "ra_t", "web_ra_t", "web_rat", "return_air_t"],
    "mat": ["mixed_air_temp", "mixed_air_temp_f", "ma_t", "web_mat", "web_ma_t", "mixed_air_t"],
    "fan_cmd": ["fan_speed", "fan_pct", "fan_percent", "supply_fan", "supply_fan_speed", "supply_fan_speed_pct"],
    "fan_status": ["fan_proof", "supply_fan_status", "supply_fan_stat"],
    "oa_damper_pct": ["oa_damper", "outside_air_damper", "oa_damper_cmd", "oa_damper_pos"],
    "damper_pct": ["damper", "zone_damper", "vav_damper", "damper_pos"],
    "clg_valve_pct": ["cooling_valve", "cooling_cmd", "clg_valve", "chw_valve", "chw_valve_pct", "cooling_valve_pct"],
    "htg_valve_pct": ["heating_valve", "heating_cmd", "htg_valve", "heating_valve_pct", "hw_valve_pct"],
    "reheat_valve_pct": ["reheat_valve", "rht_valve"],
    "sat_sp": ["sat_setpoint", "dat_reset", "dat_reset_f", "sat_sp_f", "sat_setpoint_f", "discharge_air_temp_sp",
               "cooling_setpoint", "effective_setpoint", "clg_stpt"],
    "duct_static": ["da_p_inwc", "duct_static_inwc", "duct_static_pressure"],
    "duct_static_sp": ["da_p_setpoint_inwc", "duct_press_sp", "duct_static_pressure_sp"],
    "static_reset_request": ["vav_pressure_request_sum"],
    "cooling_coil_entering_temp": ["ccet"], "cooling_coil_leaving_temp": ["cclt"],
    "heating_coil_entering_temp": ["hcet"], "heating_coil_leaving_temp": ["hclt"],
    "chiller_status": ["chiller_proof"], "chiller_power": ["power"], "chiller_amps": ["chiller_amp"],
    "vav_total_flow": ["vav_total_airflow", "total_airflow", "ahu_total_airflow"],
    "zone_flow": ["airflow", "actflow", "flow_input", "zone_airflow"],
    "min_flow_sp": ["minflowsp", "min_airflow"], "loop_enabled": ["pid_enable"],
    "chw_supply_t": ["chws_t", "chw_supply", "chwst", "chws_t_f", "chilled_water_supply_temp", "chw_st"],
    "chw_return_t": ["chwr_t", "chw_return", "chwrt", "chwr_t_f", "chilled_water_return_temp", "chw_rt"],
    "chw_supply_sp": ["chilled_water_supply_temp_sp"], "chw_dp": ["chw_diff_pressure"],
    "chw_dp_sp": ["chw_diff_pressure_sp"],
    "hw_supply_t": ["hws_t", "hw_supply", "hwst", "hws_t_f", "hot_water_supply_temp"],
    "hw_return_t": ["hwr_t", "hw_return", "hwrt", "hwr_t_f", "hot_water_return_temp"],
    "oa_h": ["oa_humidity", "relative_humidity_pct", "oa_rh_pct", "outside_air_humidity"],
    "occ_mode": ["occupancy", "occupied", "schedule"], "return_fan": ["return_fan_cmd"],
    "tower_fan_cmd": ["cw_fan_cmd"], "cw_supply_t": ["condenser_water_supply_temp"],
    "cw_return_t": ["condenser_water_return_temp"], "preheat_leave_t": ["preheat_leaving_temp"],
    "web_oa_t": ["web_outside_air_temp"], "web_oa_dp": ["web_outside_air_dewpoint"],
    "web_wb_t": ["web_outside_air_wetbulb"], "vav_discharge_t": ["vav_discharge_air_temp"],
    "vav_inlet_t": ["vav_inlet_air_temp"], "ahu_sat": ["ahu_discharge_air_temp"],
}
ALIAS_TO_ROLE = {a: r for r, names in ROLE_ALIASES.items() for a in names}


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def canonical_role(name: Column) -> Column:
    """S-6: alias to role by a literal map (a fixed table of some hundred names); names that
    are not aliases stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in ALIAS_TO_ROLE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, slug(name)), slug(name))


def resolve_roles(names: DataFrame, *, column: str = "point_role") -> DataFrame:
    return names.withColumn("role", canonical_role(C(column)))


def column_score(role: Column, column: Column) -> Column:
    """S-7: how well a physical column suits a role; negative means never."""
    c = F.lower(column)
    has = lambda *xs: holds(c.rlike("|".join(xs)))
    zero = F.lit(0)
    return (F.when(role == "sat", F.when(c == "discharge_air_temp_f", 100).when(has("discharge_air"), 80)
                   .when(has("dat_y"), 60).when(has("dat_x"), 10).when(has("^dat_"), 5).otherwise(zero))
             .when(role == "sat_sp", F.when(has("dat_reset"), 100).when(has("sat_sp", "sat_setpoint"), 90).otherwise(zero))
             .when(role == "oa_damper_pct", F.when(has("enable", "minimum", "min_pos", "minpos"), -100)
                   .when(has("mad_c", "mad-c$", "mixed_air_damper"), 100).when(has("ex_dmpr", "oa_damper"), 90)
                   .when(has("damper", "dmpr"), 70).otherwise(zero))
             .when(role == "damper_pct", F.when(has("ex_dmpr", "oa_damper", "outdoor_air", "mad_c", "oad_",
                                                    "heatingdamper", "heating_damper"), -100)
                   .when(has("actuatorcommand"), 100).when(has("damper_pct", "damper_pos"), 80)
                   .when(has("dpr_pos", "vavactuator"), 70).otherwise(zero))
             .when(role == "zone_flow", F.when(has("setpoint", "minflow", "maxflow", "min_flow", "max_flow", "_sp",
                                                   "stby", "unocc"), -100)
                   .when(has("actflow"), 100).when(has("flow_input"), 90).when(has("airflow"), 50).otherwise(zero))
             .when(role == "fan_cmd", F.when(has("supply_fan") & ~has("status"), 100)
                   .when(has("fan_cmd", "fan_speed"), 90).otherwise(zero))
             .when(role == "mat", F.when(has("mixed_air") & ~has("damper"), 100)
                   .when(has("mad_c", "mad-c$"), -100).otherwise(zero))
             .when(role == "chiller_power", F.when(has("peak", "kva", "va_demand"), -100).when(has("this_interval"), 100)
                   .when(has("meter_power_sum"), 90).when(has("chiller_power"), 80).otherwise(zero))
             .when(role == "chiller_status", F.when(has("override", "tstat"), -100).when(has("command"), 100)
                   .when(has("chiller_status"), 90).otherwise(zero))
             .otherwise(zero))


def pick_best_column(columns: DataFrame) -> DataFrame:
    """S-7: `columns` has equipment_id, role, column; the best-scoring one per role stays."""
    w = Window.partitionBy(*ID, "role").orderBy(F.desc("score"), "column")
    return (columns.withColumn("score", column_score(C("role"), C("column")))
                   .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def suggest_roles(names: DataFrame, patterns, *, key: str, column: str) -> DataFrame:
    """S-8: the first pattern with a substring hit gives the role (NULL: unmapped).
    `patterns` is an ordered list of (role, [substrings]) and becomes one expression."""
    c, out = F.lower(C(column)), None
    for role, subs in patterns:
        hit = _contains_any(c, subs)
        out = F.when(hit, F.lit(role)) if out is None else out.when(hit, F.lit(role))
    return names.select(key, column, out.alias("role"))


def suggest_columns(names: DataFrame, patterns, *, keys, column: str) -> DataFrame:
    """S-8: per key and suggested role the column that suits best (equal scores: the first by name); columns that never suit are out.
    One aggregation with partial minima, so an equipment with very many columns is no large group."""
    found = suggest_roles(names.select(F.struct(*keys).alias("_key"), column), patterns, key="_key", column=column).where(C("role").isNotNull())
    ranked = found.withColumn("_score", column_score(C("role"), C(column))).where("_score >= 0")
    best = ranked.groupBy("_key", "role").agg(F.min(F.struct((-C("_score")).alias("s"), C(column).alias("c"))).alias("_best"))
    return best.select("_key.*", "role", C("_best.c").alias(column), (-C("_best.s")).alias("score"))


def suggest_unmapped(names: DataFrame, patterns, *, keys, column: str) -> DataFrame:
    """S-8: the columns of each key that no pattern hits."""
    found = suggest_roles(names.select(F.struct(*keys).alias("_key"), column), patterns, key="_key", column=column)
    return found.where("role IS NULL").select("_key.*", column).distinct()


def _contains_any(c: Column, subs) -> Column:
    out = c.contains(subs[0])
    for s in subs[1:]:
        out = out | c.contains(s)
    return out
