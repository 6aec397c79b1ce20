"""SQL oracles for the analytics, fuel and findings queries."""

from __future__ import annotations

from oracle.core_sql import B, EQW, KIND, RAW, RW, half_up, islands, sec, ts
from oracle.rules_sql import PREDICATES, fan, n, n0, rule_sql
from thermaline.plans.analytics import BROKEN_BOX_RULES, MATRICES, PRESETS

O: dict[str, str] = {}
COOL = "(COALESCE(chiller_status > 0.05, FALSE) OR COALESCE(compressor_status > 0.05, FALSE) OR COALESCE(chiller_cmd > 0.05, FALSE))"
FANQ = f"COALESCE(CASE WHEN fan_status IS NOT NULL THEN fan_status > 0.05 ELSE {n('fan_cmd')} > 0.01 END, FALSE)"
PLANT = f"({COOL} OR {FANQ} OR COALESCE(pump_status > 0.05, FALSE) OR COALESCE(chw_pump_status > 0.05, FALSE))"
FOFF = f"{fan('FALSE')}"


def leads(src: str, on: str, gap: float, w: str = EQW, extra: str = "") -> str:
    return (f"q AS (SELECT *, {on} AS ison, {sec('LEAD(timestamp_utc) OVER (' + w + ')')} - {sec('timestamp_utc')} AS g{extra} FROM {src}), "
            f"d AS (SELECT *, CASE WHEN g IS NULL THEN NULL ELSE GREATEST(0, LEAST({gap}, g)) END AS dt FROM q)")


def _runtime(digits: int) -> str:
    return (f"SELECT equipment_id, ROUND(COALESCE(SUM(CASE WHEN ison THEN dt END), 0) / 3600, {digits}) AS run_hours, "
            f"ROUND(CASE WHEN {sec('MAX(timestamp_utc)')} > {sec('MIN(timestamp_utc)')} THEN 100 * SUM(dt) / ({sec('MAX(timestamp_utc)')} - {sec('MIN(timestamp_utc)')}) ELSE 0 END, {digits}) AS coverage_pct, "
            "COUNT(*) AS samples, COUNT(*) FILTER (WHERE ison) AS on_samples FROM d GROUP BY 1 HAVING COUNT(*) > 1")


O["runtime_hours"] = f"WITH {B}, {leads('history', PLANT, 900)} {_runtime(6)}"
O["runtime_hours_irregular"] = f"WITH {RAW}, {leads('raw', 'is_on', 7200, RW)} {_runtime(4)}"
SITE = "site AS (SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t IS NOT NULL GROUP BY 1)"
O["runtime_weekly"] = (
    f"WITH {B}, {SITE}, {leads('history', PLANT, 900)} SELECT equipment_id, strftime(date_trunc('week', timestamp_utc), '%Y-%m-%d') AS week, "
    "ROUND(SUM(CASE WHEN ison THEN dt ELSE 0 END) / 3600, 6) AS run_hours, ROUND(AVG(CASE WHEN ison THEN oat_f END), 6) AS avg_oat_f "
    "FROM d LEFT JOIN site USING (timestamp_utc) WHERE g IS NOT NULL GROUP BY 1, 2 HAVING SUM(CASE WHEN ison THEN dt ELSE 0 END) > 0")
MOTORS = {"fan_status": "fan", "fan_cmd": "fan", "pump_status": "pump", "chw_pump_status": "pump", "chw_pump_cmd": "pump", "tower_fan_cmd": "tower"}
_mt = " UNION ALL ".join(f"SELECT equipment_id, '{s}' AS signal, '{k}' AS motor_kind, (CASE WHEN {s} > 1.5 THEN {s} / 100 ELSE {s} END) > 0.05 AS o FROM history WHERE {s} IS NOT NULL" for s, k in MOTORS.items())
MOTOR = (f"mt AS ({_mt}), mr AS (SELECT equipment_id, signal, motor_kind, COUNT(*) AS samples, COUNT(*) FILTER (WHERE o) AS on_samples, "
         "COUNT(*) FILTER (WHERE o) * 300 / 3600.0::DOUBLE AS run_hours FROM mt GROUP BY 1, 2, 3)")
O["motor_run_hours"] = f"WITH {B}, {MOTOR} SELECT equipment_id, signal, motor_kind, samples, on_samples, ROUND(run_hours, 6) AS run_hours FROM mr"
O["motor_run_totals"] = (
    f"WITH {B}, {MOTOR}, k AS (SELECT * FROM mr m WHERE NOT (signal = 'fan_cmd' AND EXISTS (SELECT 1 FROM mr x WHERE x.equipment_id = m.equipment_id AND x.signal = 'fan_status')) "
    "AND NOT (signal = 'chw_pump_cmd' AND EXISTS (SELECT 1 FROM mr x WHERE x.equipment_id = m.equipment_id AND x.signal = 'pump_status'))) "
    "SELECT ROUND(SUM(run_hours) FILTER (WHERE motor_kind = 'fan'), 6) AS fan_hours, ROUND(SUM(run_hours) FILTER (WHERE motor_kind = 'pump'), 6) AS pump_hours, "
    "ROUND(SUM(run_hours) FILTER (WHERE motor_kind IN ('fan', 'pump')), 6) AS total_hours FROM k")
O["discover_plant_motors"] = (
    "WITH p AS (SELECT p_partkey % 6 AS k FROM part) SELECT CASE k WHEN 0 THEN 'pump' WHEN 1 THEN 'pump' WHEN 2 THEN 'fan' WHEN 3 THEN 'tower' ELSE 'chiller' END AS motor_kind, "
    "CASE k WHEN 0 THEN 'chiller' WHEN 1 THEN 'boiler' WHEN 2 THEN 'air' WHEN 3 THEN 'chiller' ELSE 'chiller' END AS plant_group, COUNT(*) AS n FROM p WHERE k <> 4 GROUP BY 1, 2")
HR6 = ["sat", "mat", "zone_t", "chw_supply_t", "chiller_power", "clg_available"]


def _stats(where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT equipment_id, '{r}' AS role, COUNT(*) AS n, COUNT({r}) AS n_finite, MIN({r}) AS mn, MAX({r}) AS mx, AVG({r}) AS av, STDDEV_POP({r}) AS sd FROM history {where} GROUP BY 1" for r in HR6)


_sc = "ROUND(mn, 6) AS min, ROUND(mx, 6) AS max, ROUND(av, 6) AS mean, ROUND(sd, 6) AS std"
O["sensor_health"] = (f"WITH {B}, s AS ({_stats()}) SELECT equipment_id, role, n, n_finite, {_sc}, ROUND(100.0::DOUBLE * n_finite / n, 6) AS coverage_pct, "
                      "ROUND(1 - n_finite / n::DOUBLE, 6) AS missingness, CASE WHEN n_finite > 5 AND sd <= 1e-9 THEN 1 ELSE 0 END AS flatline FROM s WHERE n_finite > 0")
O["sensor_stats_fan_on"] = f"WITH {B}, s AS ({_stats('WHERE ' + FOFF)}) SELECT equipment_id, role, n, n_finite, {_sc} FROM s WHERE n_finite > 0"
OCC = ("(CASE WHEN occ_mode IS NULL THEN NULL WHEN TRY_CAST(TRIM(occ_mode) AS DOUBLE) IS NOT NULL THEN TRY_CAST(TRIM(occ_mode) AS DOUBLE) > 0.05 "
       "ELSE LOWER(TRIM(occ_mode)) NOT IN ('unoccupied','unocc','off','false','night','standby','setback','no') END)")
O["setpoints"] = f"WITH {B}, s AS (SELECT *, {OCC} AS occ FROM history) " + " UNION ALL ".join(
    f"SELECT equipment_id, '{r}' AS role, ROUND(quantile_cont({r}, 0.5) FILTER (WHERE occ), 6) AS median_occupied, ROUND(quantile_cont({r}, 0.5) FILTER (WHERE NOT occ), 6) AS median_unoccupied, "
    f"ROUND(quantile_cont({r}, 0.5), 6) AS median_all, COUNT({r}) FILTER (WHERE occ) AS n_occupied, COUNT({r}) FILTER (WHERE NOT occ) AS n_unoccupied FROM s GROUP BY 1"
    for r in ("sat_sp", "duct_static_sp", "min_flow_sp"))
O["diurnal"] = f"WITH {B} " + " UNION ALL ".join(
    f"SELECT equipment_id, '{r}' AS role, hour(timestamp_utc)::INT AS hour, CASE WHEN {FOFF} THEN 'on' ELSE 'off' END AS fan_state, COUNT({r}) AS n, ROUND(AVG({r}), 6) AS mean, "
    f"ROUND(MIN({r}), 6) AS min, ROUND(MAX({r}), 6) AS max FROM history WHERE {r} IS NOT NULL GROUP BY 1, 3, 4" for r in ("sat", "zone_t"))
O["schedule_hours"] = (
    f"WITH {B}, o AS (SELECT * FROM history WHERE occ_mode IS NOT NULL), {leads('o', 'COALESCE(' + OCC + ', FALSE)', 900)} "
    "SELECT equipment_id, ROUND(SUM(CASE WHEN ison THEN dt ELSE 0 END) / 3600, 6) AS occupied_hours, ROUND(SUM(CASE WHEN ison THEN 0 ELSE dt END) / 3600, 6) AS unoccupied_hours, "
    "ROUND(SUM(dt) / 3600, 6) AS coverage_hours, COUNT(*) FILTER (WHERE ison) AS occupied_samples, COUNT(*) AS total_samples FROM d WHERE g IS NOT NULL GROUP BY 1")
O["after_hours_fan"] = (
    f"WITH {B}, {leads('history', FOFF, 900)}, oc AS (SELECT equipment_id, timestamp_utc, {OCC} AS occupied FROM history WHERE occ_mode IS NOT NULL), "
    "fo AS (SELECT equipment_id, arg_min(occupied, timestamp_utc) AS f FROM oc GROUP BY 1), "
    "j AS (SELECT d.equipment_id, d.ison, COALESCE(d.dt, 0) AS dt, oc.occupied FROM d ASOF LEFT JOIN oc ON d.equipment_id = oc.equipment_id AND d.timestamp_utc >= oc.timestamp_utc) "
    "SELECT equipment_id, ROUND(SUM(CASE WHEN ison AND NOT COALESCE(occupied, f) THEN dt ELSE 0 END) / 3600, 6) AS after_hours_fan_h FROM j JOIN fo USING (equipment_id) GROUP BY 1")
O["occupied_mask"] = (
    f"WITH {RAW}, l AS (SELECT equipment_id, (timestamp_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS t FROM raw), m AS (SELECT equipment_id, isodow(t) AS dw, hour(t) * 60 + minute(t) AS mi FROM l) "
    "SELECT equipment_id, COUNT(*) FILTER (WHERE (dw <= 4 AND mi >= 420 AND mi < 1080) OR (dw = 5 AND (mi >= 1200 OR mi < 300)) OR (dw = 7 AND mi >= 540 AND mi < 720)) AS occupied, "
    "COUNT(*) AS samples FROM m GROUP BY 1")
O["day_type"] = (
    "WITH h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 450000) SELECT CASE WHEN h.d IS NOT NULL THEN 'holiday' WHEN isodow(l_shipdate) >= 6 THEN 'weekend' "
    "ELSE 'weekday' END AS day_type, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean_quantity FROM lineitem LEFT JOIN h ON CAST(l_shipdate AS DATE) = h.d GROUP BY 1")


def _bins(dev_where: str, oat: str) -> str:
    return (f"cs AS (SELECT h.equipment_id, h.timestamp_utc, {COOL} AS c, o.oat_f FROM history h LEFT JOIN ({oat}) o USING (timestamp_utc) {dev_where}), {leads('cs', 'c', 900)}, "
            "db AS (SELECT equipment_id, FLOOR(oat_f / 5) * 5.0::DOUBLE AS bin_lo, SUM(dt) / 3600 AS hours FROM d WHERE g IS NOT NULL AND ison AND oat_f IS NOT NULL GROUP BY 1, 2), "
            "anyd AS (SELECT timestamp_utc, BOOL_OR(c) AS c, MAX(oat_f) AS oat_f FROM cs WHERE oat_f IS NOT NULL GROUP BY 1), "
            f"aq AS (SELECT *, {sec('LEAD(timestamp_utc) OVER (ORDER BY timestamp_utc)')} - {sec('timestamp_utc')} AS g FROM anyd) "
            "SELECT equipment_id, 'individual_device' AS series_kind, bin_lo, ROUND(hours, 6) AS hours FROM db UNION ALL "
            "SELECT 'ALL', 'aggregate_device_hours', bin_lo, ROUND(SUM(hours), 6) FROM db GROUP BY bin_lo UNION ALL "
            "SELECT 'ANY', 'aggregate_active_hours', FLOOR(oat_f / 5) * 5.0::DOUBLE, ROUND(SUM(GREATEST(0, LEAST(900, g))) / 3600, 6) FROM aq WHERE g IS NOT NULL AND c GROUP BY 3")


O["oat_bins"] = f"WITH {B}, " + _bins(f"WHERE {KIND.replace('equipment_id', 'h.equipment_id')} IN ('chiller', 'heatpump')",
                                      "SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t BETWEEN 40 AND 110 GROUP BY 1")
O["oat_bins_weather_first"] = f"WITH {B}, " + _bins(
    "", "SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t BETWEEN 40 AND 110 AND (UPPER(equipment_id) LIKE '%WEATHER%' "
    "OR NOT EXISTS (SELECT 1 FROM history WHERE oa_t BETWEEN 40 AND 110 AND UPPER(equipment_id) LIKE '%WEATHER%')) GROUP BY 1")
BW = ("b1 AS (SELECT timestamp_utc, AVG(oa_t) AS b FROM history WHERE oa_t IS NOT NULL GROUP BY 1), w1 AS (SELECT timestamp_utc, AVG(web_oa_t) AS w FROM history WHERE web_oa_t IS NOT NULL GROUP BY 1), "
      "bw AS (SELECT timestamp_utc, b, w, b - w AS dl FROM b1 JOIN w1 USING (timestamp_utc))")
O["bas_vs_web"] = f"WITH {B}, {BW} SELECT {ts('timestamp_utc')}, ROUND(b, 6) AS bas_oat_f, ROUND(w, 6) AS web_oat_f, ROUND(dl, 6) AS delta_f FROM bw"
O["bas_vs_web_histogram"] = f"WITH {B}, {BW} SELECT FLOOR(dl)::DOUBLE AS delta_lo, COUNT(*) AS n FROM bw GROUP BY 1"
O["economizer_metrics"] = (f"WITH {B} SELECT equipment_id, COUNT(*) FILTER (WHERE {FOFF}) AS n_fan_on, COUNT(*) FILTER (WHERE {FOFF} AND ABS(oa_t - rat) >= 10) AS n_identifiable, "
                           f"COUNT(oa_damper_pct) AS n_damper FROM history GROUP BY 1 HAVING COUNT(*) FILTER (WHERE {FOFF}) > 0")
PCT = "(CASE WHEN oa_damper_pct > 1 THEN oa_damper_pct ELSE oa_damper_pct * 100 END)"
ECP = (f"ep AS (SELECT building_id, equipment_id, timestamp_utc AS t, oa_t AS oat_f, rat AS rat_f, mat AS mat_f, {PCT} AS damper_fb_pct, oa_t - rat AS delta_or_f, mat - rat AS delta_mr_f, "
       f"CASE WHEN ABS(oa_t - rat) >= 10 THEN 1 ELSE 0 END AS identifiable, CASE WHEN ABS(oa_t - rat) >= 10 THEN GREATEST(-20, LEAST(120, 100 * (mat - rat) / (oa_t - rat))) END AS oa_frac_pct, "
       f"mat - (rat + {PCT} / 100 * (oa_t - rat)) AS mat_resid_f FROM history WHERE {FOFF} AND oa_t IS NOT NULL AND rat IS NOT NULL AND mat IS NOT NULL)")
_e6 = ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("oat_f", "rat_f", "mat_f", "damper_fb_pct", "delta_or_f", "delta_mr_f", "oa_frac_pct", "mat_resid_f"))
O["economizer_points"] = f"WITH {B}, {ECP} SELECT equipment_id, {ts('t', 'timestamp_utc')}, identifiable, {_e6} FROM ep"
O["economizer_top_points"] = (f"WITH {B}, {ECP} SELECT building_id, equipment_id, {ts('t', 'timestamp_utc')}, ROUND(oat_f, 6) AS oat_f, ROUND(rat_f, 6) AS rat_f, ROUND(mat_f, 6) AS mat_f FROM ep "
                              "ORDER BY identifiable DESC, t, building_id, equipment_id LIMIT 200")
O["economizer_residuals"] = (f"WITH {B}, {ECP} SELECT equipment_id, ROUND(quantile_cont(mat_resid_f, 0.5), 6) AS median_mat_resid_f, ROUND(AVG(ABS(mat_resid_f)), 6) AS mat_resid_mae_f FROM ep "
                             "WHERE identifiable = 1 AND mat_resid_f IS NOT NULL GROUP BY 1")
O["economizer_points_per_equipment"] = (
    f"WITH {B}, {ECP}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY equipment_id ORDER BY t) AS i, COUNT(*) OVER (PARTITION BY equipment_id) AS c FROM ep) "
    f"SELECT equipment_id, {ts('t', 'timestamp_utc')}, ROUND(delta_or_f, 6) AS delta_or_f FROM r WHERE c <= 60 OR (i - 1) % GREATEST(1, c // 60) = 0")
_fr = "COALESCE(web_oa_t >= 60 AND web_oa_t < 72 AND web_oa_dp < 60, FALSE)"
_dm = n0("oa_damper_pct")
MASKS = {"opportunity_hours": _fr, "integrated_compliant_hours": f"{_fr} AND {n0('clg_valve_pct')} > 0.01 AND {_dm} >= 0.9",
         "integrated_noncompliant_hours": f"{_fr} AND {n0('clg_valve_pct')} > 0.01 AND {_dm} < 0.9", "prohibited_mech_hours": f"COALESCE(web_oa_t < 60, FALSE) AND {COOL}",
         "winter_economizing_hours": f"COALESCE(web_oa_t < 25, FALSE) AND {_dm} > 0.25"}
_mc = ", ".join(f"MAX(CASE WHEN {m} THEN 1 ELSE 0 END) AS {k}" for k, m in MASKS.items())
O["economizer_weather_summary"] = (
    f"WITH {B}, p AS (SELECT equipment_id, timestamp_utc, {_mc}, COUNT(*) FILTER (WHERE web_oa_t IS NOT NULL AND web_oa_dp IS NOT NULL) AS wx, COUNT(*) AS c FROM history "
    f"WHERE {KIND} IN ('ahu', 'chiller', 'heatpump') GROUP BY 1, 2), {leads('p', 'TRUE', 900)} SELECT equipment_id, "
    + ", ".join(f"ROUND(SUM({k} * COALESCE(dt, 0)) / 3600, 6) AS {k}" for k in MASKS) + ", ROUND(SUM(wx) / SUM(c)::DOUBLE, 6) AS weather_coverage FROM d GROUP BY 1")


# --- health ----------------------------------------------------------------------------------
def results(rules) -> str:
    r = rule_sql()
    parts = [f"SELECT equipment_id, '{i}' AS rule_id, CASE WHEN fault_hours > 0 THEN 'FAULT' ELSE 'PASS' END AS status, ROUND(fault_hours * 12) * 300 / 3600.0::DOUBLE AS fault_hours FROM ({r[i]})" for i in rules]
    return "res AS (" + " UNION ALL ".join(parts) + ")"


def _matrix(name: str) -> str:
    kinds, faults_only, flags = MATRICES[name]
    rules = list(dict.fromkeys(x for rs in flags.values() for x in rs))
    where = f"WHERE {KIND} IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    cols = []
    for k, rs in flags.items():
        f = "COALESCE(" + ", ".join(f"MAX(CASE WHEN rule_id = '{r}' THEN CASE WHEN status = 'FAULT' THEN 1 ELSE 0 END END)" for r in rs) + ")"
        h = "COALESCE(" + ", ".join(f"MAX(CASE WHEN rule_id = '{r}' THEN fault_hours END)" for r in rs) + ")"
        cols.append(f"{f} AS {k}, {h} AS {k}_fault_h")
    hit = " + ".join(f"COALESCE({k}, 0)" for k in flags)
    known = " + ".join(f"({k} IS NOT NULL)::INT" for k in flags)
    tot = " + ".join(f"CASE WHEN {k} = 1 THEN {k}_fault_h ELSE 0 END" for k in flags)
    body = ", ".join(f"{k}, ROUND({k}_fault_h, 6) AS {k}_fault_h" for k in flags)
    return (f"WITH {results(rules)}, w AS (SELECT equipment_id, {', '.join(cols)} FROM res {where} GROUP BY 1) SELECT equipment_id, {body}, {hit} AS dimensions_hit, {known} AS dimensions_evaluable, "
            f"ROUND({tot}, 6) AS total_fault_h, CASE WHEN {known} < {len(flags)} THEN '?' ELSE CAST({hit} AS VARCHAR) END || '/{len(flags)}' AS score_label FROM w"
            + (f" WHERE {hit} > 0" if faults_only else ""))


for _m in MATRICES:
    O[f"health_{_m}"] = _matrix(_m)
O["vav_health"] = (
    f"WITH {B}, {results(BROKEN_BOX_RULES)}, b AS (SELECT equipment_id, COUNT(*) FILTER (WHERE zone_t < 70 OR zone_t > 75) * 300 / 3600.0::DOUBLE AS cf, "
    f"COUNT(*) FILTER (WHERE {n('damper_pct')} >= 0.975) * 300 / 3600.0::DOUBLE AS fo, COUNT(*) * 300 / 3600.0::DOUBLE AS sp FROM history WHERE equipment_id LIKE 'VAV%' GROUP BY 1), "
    "k AS (SELECT equipment_id, MAX(CASE WHEN status = 'FAULT' THEN 1 ELSE 0 END) AS br, SUM(CASE WHEN status = 'FAULT' THEN fault_hours ELSE 0 END) AS bh FROM res GROUP BY 1), "
    "j AS (SELECT b.*, COALESCE(br, 0) AS br, COALESCE(bh, 0) AS bh, CASE WHEN cf > 0.01 THEN 1 ELSE 0 END AS pz, CASE WHEN sp >= 20 THEN CASE WHEN 100 * fo / sp >= 95 THEN 1 ELSE 0 END END AS rd FROM b LEFT JOIN k USING (equipment_id)) "
    "SELECT equipment_id, ROUND(cf, 6) AS comfort_fail_h, ROUND(fo, 6) AS full_open_h, ROUND(sp, 6) AS span_h, ROUND(bh, 6) AS broken_fault_h, pz AS poor_zone, rd AS rogue_damper, br AS broken_box, "
    "pz + COALESCE(rd, 0) + br AS dimensions_hit, CASE WHEN rd IS NULL THEN '?/3' ELSE (pz + rd + br) || '/3' END AS score_label FROM j")
O["zone_comfort_rank"] = (
    f"WITH {B}, f AS (SELECT * FROM history WHERE zone_t IS NOT NULL AND (occ_mode IS NULL OR CASE WHEN TRY_CAST(TRIM(occ_mode) AS DOUBLE) IS NOT NULL THEN TRY_CAST(TRIM(occ_mode) AS DOUBLE) > 0.05 "
    "ELSE UPPER(TRIM(occ_mode)) IN ('OCC','OCCUPIED','TRUE','YES','1','1.0','ON') END)), r AS (SELECT equipment_id, COUNT(*) AS n_samples, COUNT(*) FILTER (WHERE zone_t < 70) AS n_below, "
    "COUNT(*) FILTER (WHERE zone_t > 75) AS n_above, AVG(zone_t) AS mz, 100.0::DOUBLE * COUNT(*) FILTER (WHERE zone_t < 70 OR zone_t > 75) / COUNT(*) AS fp FROM f GROUP BY 1) "
    "SELECT equipment_id, n_samples, n_below, n_above, ROUND(mz, 6) AS mean_zone_t, ROUND(fp, 6) AS fail_pct, CASE WHEN ABS(fp - (SELECT AVG(fp) FROM r)) / (SELECT STDDEV_POP(fp) FROM r) >= 1.2 THEN 1 ELSE 0 END AS outlier FROM r")
O["ahu_reset_evidence"] = (f"WITH {B} SELECT equipment_id, " + ", ".join(
    f"ROUND(100.0::DOUBLE * COUNT({r}) / COUNT(*), 6) AS {r}_coverage_pct, ROUND(MAX({r}) - MIN({r}), 6) AS {r}_span, COUNT(DISTINCT ROUND({r}, 2)) AS {r}_levels" for r in ("sat_sp", "duct_static_sp"))
    + " FROM history WHERE equipment_id LIKE 'AHU%' GROUP BY 1")
THIN = "(i = 1 OR i = c OR i % ((c + {0} - 1) // {0}) = 0)"
O["timeseries_thinned"] = (
    f"WITH {B}, r AS (SELECT equipment_id, timestamp_utc, zone_t, ROW_NUMBER() OVER ({EQW}) AS i, COUNT(*) OVER (PARTITION BY equipment_id) AS c FROM history WHERE zone_t IS NOT NULL) "
    f"SELECT equipment_id, {ts('timestamp_utc')}, ROUND(zone_t, 6) AS value_f FROM r WHERE {THIN.format(50)}")
O["oat_scatter"] = (
    f"WITH {B}, s AS (SELECT timestamp_utc, AVG(oa_t) AS o, AVG(web_oa_t) AS w FROM history GROUP BY 1) SELECT equipment_id, {ts('timestamp_utc')}, ROUND(sat_sp, 6) AS y_f, ROUND(o, 6) AS oat_f, ROUND(w, 6) AS driver_f "
    "FROM history JOIN s USING (timestamp_utc) WHERE sat_sp IS NOT NULL AND o IS NOT NULL")


def _five(c: str) -> str:
    return (f"COUNT({c}) AS n, AVG({c}) AS av, STDDEV_POP({c}) AS sd, MIN({c}) AS mn, MAX({c}) AS mx, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3")


_f5 = "n, ROUND(av, 6) AS mean, ROUND(sd, 6) AS std, ROUND(mn, 6) AS min, ROUND(q1, 6) AS p25, ROUND(q2, 6) AS p50, ROUND(q3, 6) AS p75, ROUND(mx, 6) AS max"
O["five_number"] = (f"WITH {B}, r AS (SELECT equipment_id, {_five('zone_t')} FROM history WHERE zone_t IS NOT NULL GROUP BY 1) SELECT equipment_id, {_f5}, "
                    "CASE WHEN ABS(av - (SELECT AVG(av) FROM r)) / (SELECT STDDEV_POP(av) FROM r) >= 1.5 THEN 1 ELSE 0 END AS outlier FROM r")
O["by_fan_mode"] = (f"WITH {B}, m AS (SELECT equipment_id, duct_static AS v, UNNEST(['all', CASE WHEN {FOFF} THEN 'on' ELSE 'off' END]) AS mode FROM history WHERE duct_static IS NOT NULL), "
                    f"r AS (SELECT equipment_id, mode, {_five('v')} FROM m GROUP BY 1, 2) SELECT equipment_id, mode, {_f5} FROM r")
O["inspect_page"] = (f"WITH {B} SELECT building_id, equipment_id, {ts('timestamp_utc')}, ROUND(sat, 6) AS sat, ROUND(mat, 6) AS mat FROM history h WHERE h.timestamp_utc >= TIMESTAMP '2024-01-01 06:00:00' "
                     "ORDER BY h.timestamp_utc, building_id, equipment_id LIMIT 100")
O["descriptive_counts"] = f"WITH {B} SELECT equipment_id, COUNT(*) AS rows FROM history WHERE zone_t > 70 GROUP BY 1"
O["dataset_time_span"] = f"WITH {RAW} SELECT {ts('MIN(timestamp_utc)', 'first_ts')}, {ts('MAX(timestamp_utc)', 'last_ts')}, ROUND(({sec('MAX(timestamp_utc)')} - {sec('MIN(timestamp_utc)')}) / 3600, 6) AS hours FROM raw"
O["readings_window"] = (
    f"WITH {B}, l AS (SELECT equipment_id, timestamp_utc, sat FROM history WHERE timestamp_utc >= (SELECT MAX(timestamp_utc) FROM history) - INTERVAL 12 HOUR), "
    f"a AS (SELECT *, AVG(sat) OVER ({EQW} RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS av, ROW_NUMBER() OVER ({EQW}) AS i, COUNT(*) OVER (PARTITION BY equipment_id) AS c FROM l) "
    f"SELECT equipment_id, {ts('timestamp_utc')}, ROUND(sat, 6) AS sat, ROUND(av, 6) AS sat_avg FROM a WHERE {THIN.format(40)}")
O["evidence_availability"] = (f"WITH {B} SELECT equipment_id, CASE WHEN COUNT(oa_t) + COUNT(web_oa_t) > 0 THEN 1 ELSE 0 END AS has_oat, "
                              "CASE WHEN COUNT(chiller_status) + COUNT(compressor_status) + COUNT(chiller_cmd) + COUNT(chiller_amps) + COUNT(chiller_power) > 0 THEN 1 ELSE 0 END AS has_cooling_proof, COUNT(*) AS rows FROM history GROUP BY 1")
_signals = {"chiller_status": "0.05", "compressor_status": "0.05", "chiller_cmd": "0.05", "chiller_amps": "5", "chiller_power": "1"}
_idle = ", ".join(f"CASE WHEN starts_with(equipment_id, 'AHU') AND {c} IS NOT NULL THEN 0 ELSE {c} END AS {c}" for c in list(_signals)[:3])
_counts = ", ".join(f"COUNT(*) FILTER (WHERE {c} > {v}) AS on_{c}, COUNT({c}) AS n_{c}" for c, v in _signals.items())
_first = " ".join([*[f"WHEN on_{c} > 0 THEN '{c}'" for c in _signals], *[f"WHEN n_{c} > 0 THEN '{c}'" for c in _signals]])
_chosen = " ".join(f"WHEN '{c}' THEN on_{c}" for c in _signals)
O["cooling_run_proof"] = (
    f"WITH {B}, h AS (SELECT equipment_id, {_idle}, CASE WHEN NOT starts_with(equipment_id, 'HEATPUMP') THEN chiller_amps END AS chiller_amps, chiller_power FROM history), "
    f"c AS (SELECT equipment_id, COUNT(*) AS samples, {_counts} FROM h GROUP BY 1), p AS (SELECT *, CASE {_first} END AS proof_role FROM c) "
    "SELECT equipment_id, proof_role, CASE WHEN proof_role IN ('chiller_amps', 'chiller_power') THEN 'analog' WHEN proof_role IS NOT NULL THEN 'direct' END AS proof_quality, "
    f"CASE proof_role {_chosen} ELSE 0 END AS on_samples, samples FROM p")
O["cooling_eligibility"] = (
    "WITH p AS (SELECT 'B' || (p_partkey % 2 + 1) AS building_id, p_brand || '_' || (p_size % 7) AS equipment_id, MAX(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS pr, MAX(CASE WHEN p_type IN ('SMALL','MEDIUM') THEN 1 ELSE 0 END) AS su FROM part GROUP BY 1, 2) "
    "SELECT building_id, equipment_id, CASE WHEN pr = 1 AND su = 1 THEN 'high' WHEN pr = 1 OR su = 1 THEN 'medium' ELSE 'none' END AS confidence, GREATEST(pr, su) AS eligible FROM p")
O["metering_monthly"] = (
    f"WITH {B}, o AS (SELECT strftime(timestamp_utc, '%Y-%m') AS month, AVG(oa_t) AS t FROM history WHERE oa_t IS NOT NULL GROUP BY 1), "
    "m AS (SELECT equipment_id, strftime(timestamp_utc, '%Y-%m') AS month, AVG(elec_power) AS r, COUNT(*) AS c FROM history WHERE elec_power IS NOT NULL GROUP BY 1, 2) "
    "SELECT equipment_id, month, ROUND(r, 4) AS avg_rate, c AS n_samples, ROUND(t, 4) AS avg_oat_f, ROUND(r * c * 5 / 60, 4) AS energy, "
    "ROUND(GREATEST(COALESCE(t, 65) - 65, 0) * GREATEST(c * 5 / 1440.0::DOUBLE, 1), 4) AS degree_days FROM m LEFT JOIN o USING (month)")
O["integrate_rate_monthly"] = (
    f"WITH {RAW}, q AS (SELECT *, {sec('timestamp_utc')} - {sec('LAG(timestamp_utc) OVER (' + RW + ')')} AS g FROM raw), md AS (SELECT equipment_id, quantile_cont(g, 0.5) AS m0 FROM q GROUP BY 1), "
    "x AS (SELECT q.*, CASE WHEN m0 > 0 THEN m0 ELSE 300 END AS m FROM q JOIN md USING (equipment_id)) SELECT equipment_id, strftime(timestamp_utc, '%Y-%m') AS month, "
    "ROUND(SUM(value * GREATEST(0, LEAST(COALESCE(g, m), m * 3)) / 3600), 3) AS energy, COUNT(value) AS n_samples, ROUND(AVG(value), 3) AS mean_rate, ROUND(MAX(value), 3) AS max_rate FROM x GROUP BY 1, 2")
DD = ("dy AS (SELECT CAST(l_shipdate AS DATE) AS dd, AVG(l_quantity + 40) AS t FROM lineitem GROUP BY 1), ddm AS (SELECT strftime(dd, '%Y-%m') AS month, SUM(GREATEST(0, 65 - t)) AS hdd, SUM(GREATEST(0, t - 65)) AS cdd, AVG(t) AS mt FROM dy GROUP BY 1)")
O["degree_days"] = f"WITH {DD} SELECT month, ROUND(hdd, 4) AS hdd, ROUND(cdd, 4) AS cdd, ROUND(mt, 4) AS mean_oat_f FROM ddm"


def dew(t, h):
    tc = f"(({t} - 32) * 5 / 9.0::DOUBLE)"
    g = f"(LN(GREATEST(0.1, LEAST(100, {h})) / 100) + 17.625::DOUBLE * {tc} / (243.04::DOUBLE + {tc}))"
    return f"(243.04::DOUBLE * {g} / (17.625::DOUBLE - {g}) * 9 / 5.0::DOUBLE + 32)"


def wet(t, h0):
    tc, h = f"(({t} - 32) * 5 / 9.0::DOUBLE)", f"GREATEST(5, LEAST(99, {h0}))"
    return (f"(({tc} * ATAN(0.151977::DOUBLE * SQRT({h} + 8.313659::DOUBLE)) + ATAN({tc} + {h}) - ATAN({h} - 1.676331::DOUBLE) + 0.00391838::DOUBLE * POW({h}, 1.5) * ATAN(0.023101::DOUBLE * {h}) "
            "- 4.686035::DOUBLE) * 9 / 5.0::DOUBLE + 32)")


def psat(t):
    r = f"({t} + 459.67::DOUBLE)"
    return (f"EXP(-1.0440397e4::DOUBLE / {r} - 1.129465e1::DOUBLE - 2.7022355e-2::DOUBLE * {r} + 1.289036e-5::DOUBLE * {r} * {r} - 2.4780681e-9::DOUBLE * {r} * {r} * {r} + 6.5459673::DOUBLE * LN({r}))")


_pv = f"(oa_h / 100 * {psat('oa_t')})"
_w = f"(0.621945::DOUBLE * {_pv} / (14.696::DOUBLE - {_pv}))"
O["psychrometrics"] = (f"WITH {B} SELECT equipment_id, ROUND(AVG({dew('oa_t', 'oa_h')}), 6) AS dew_point_f, ROUND(AVG({wet('oa_t', 'oa_h')}), 6) AS wet_bulb_f, "
                       f"ROUND(AVG(0.24::DOUBLE * oa_t + {_w} * (1061 + 0.444::DOUBLE * oa_t)), 6) AS enthalpy_btu_lb FROM history WHERE oa_h BETWEEN 5 AND 99 GROUP BY 1")
O["merge_weather"] = (
    f"WITH {B}, wx AS (SELECT timestamp_utc, MAX(web_oa_t) AS t, MAX(oa_h) AS h, MAX(web_oa_dp) AS dp FROM weather GROUP BY 1), "
    "m AS (SELECT equipment_id, oa_t, COALESCE(web_oa_t, t) AS wt, h, COALESCE(web_oa_dp, dp) AS dp FROM history LEFT JOIN wx USING (timestamp_utc)), "
    f"x AS (SELECT *, CASE WHEN wt IS NOT NULL THEN 'web' WHEN oa_t IS NOT NULL THEN 'bas' END AS oa_t_source, COALESCE(dp, CASE WHEN h IS NULL THEN NULL ELSE {dew('wt', 'h')} END) AS d2, "
    f"CASE WHEN h IS NULL THEN NULL ELSE {wet('wt', 'h')} END AS wb FROM m) SELECT equipment_id, oa_t_source, COUNT(*) AS n, ROUND(AVG(COALESCE(wt, oa_t)), 6) AS mean_oat, ROUND(AVG(d2), 6) AS mean_dp, ROUND(AVG(wb), 6) AS mean_wb FROM x GROUP BY 1, 2")
O["weather_source_metrics"] = (
    f"WITH {B} SELECT equipment_id, ROUND(COUNT(web_oa_t) / COUNT(*)::DOUBLE, 6) AS web_share, ROUND(COUNT(*) FILTER (WHERE web_oa_t IS NULL AND oa_t IS NOT NULL) / COUNT(*)::DOUBLE, 6) AS bas_share, "
    "ROUND(AVG(ABS(oa_t - web_oa_t)), 6) AS mean_abs_diff_f, ROUND(MAX(ABS(oa_t - web_oa_t)), 6) AS max_abs_diff_f FROM history GROUP BY 1")
_cf = ", ".join(f"ROUND({f}({r}), 6) AS {r}__{nm}" for r in ("sat", "zone_t") for nm, f in (("mean", "AVG"), ("std", "STDDEV_POP"), ("min", "MIN"), ("max", "MAX")))
_rs = rule_sql()
O["clustering_features"] = (f"WITH {B}, s AS (SELECT equipment_id, {_cf} FROM history GROUP BY 1) SELECT s.*, a.fault_hours AS fault__fc1, b.fault_hours AS fault__vav_5 FROM s JOIN ({_rs['FC1']}) a USING (equipment_id) "
                            f"JOIN ({_rs['VAV-5']}) b USING (equipment_id)")
_cool = " OR ".join(f"{c} IS NOT NULL" for c in ("chiller_status", "compressor_status", "chiller_cmd", "chiller_amps", "chiller_power"))
_motor = " OR ".join(f"{c} IS NOT NULL" for c in ("fan_status", "fan_cmd", "pump_status", "chw_pump_status", "chw_pump_cmd", "tower_fan_cmd"))
_need = {"vav_health": ("(zone_t IS NOT NULL OR damper_pct IS NOT NULL)", "zone or damper"), "weekly": (f"({_motor} OR {_cool})", "motor signal"), "bins": (f"({_cool})", "cooling proof"),
         "bas_web": ("oa_t IS NOT NULL AND web_oa_t IS NOT NULL", "oa_t and web_oa_t"), "econ": (f"{FOFF} AND oa_t IS NOT NULL AND rat IS NOT NULL AND mat IS NOT NULL", "oa_t, rat and mat")}
_pc = []
for _n, (_c, _r, _k) in PRESETS.items():
    _q, _word = _need.get(_c, (f"{_r} IS NOT NULL", _r))
    _w2 = _q + (f" AND {KIND} IN ({', '.join(repr(x) for x in _k)})" if _k else "")
    _pc.append(f"SELECT '{_n}' AS preset, COUNT(DISTINCT CASE WHEN {_w2} THEN equipment_id END) AS series, COUNT(*) FILTER (WHERE {_w2}) AS rows, CASE WHEN COUNT(*) FILTER (WHERE {_w2}) = 0 THEN 'no {_word} data' END AS reason FROM history")
O["preset_coverage"] = f"WITH {B} " + " UNION ALL ".join(_pc)
O["preset_zone_temps"] = f"WITH {B}, r AS (SELECT equipment_id, {_five('zone_t')} FROM history WHERE {KIND} IN ('vav', 'zone') AND zone_t IS NOT NULL GROUP BY 1) SELECT equipment_id, {_f5} FROM r"

# --- fuel ------------------------------------------------------------------------------------
FU = ("bills AS (SELECT 'M' || c_nationkey AS meter_id, strftime(o_orderdate, '%Y-%m') AS month, SUM(o_totalprice) AS usage, SUM(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.1::DOUBLE END) AS cost_usd, "
      "MAX(o_totalprice / 1000) AS demand_kw FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), "
      "meters AS (SELECT 'M' || n_nationkey AS meter_id, n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'electricity' ELSE 'gas' END AS fuel FROM nation), "
      "serves AS (SELECT meter_id, fuel, 'B' || k AS building_id FROM meters UNION ALL SELECT meter_id, fuel, 'B' || ((k + 1) % 25) FROM meters WHERE k % 3 = 0), "
      "buildings AS (SELECT 'B' || n_nationkey AS building_id, 10000.0::DOUBLE + n_nationkey * 1000 AS area, n_regionkey AS rk FROM nation)")
WIN = ("cm AS (SELECT month, CAST(month[1:4] AS INT) * 12 + CAST(month[6:7] AS INT) - 1 AS i FROM bills GROUP BY month HAVING COUNT(DISTINCT meter_id) = (SELECT COUNT(DISTINCT meter_id) FROM bills)), "
       "ci AS (SELECT *, i - ROW_NUMBER() OVER (ORDER BY i) AS run FROM cm), ce AS (SELECT MAX(z) AS z FROM (SELECT MAX(i) AS z FROM ci GROUP BY run HAVING COUNT(*) >= 12)), "
       "win AS (SELECT month FROM cm, ce WHERE i BETWEEN z - 11 AND z)")
O["fuel_complete_window"] = f"WITH {FU}, {WIN} SELECT month FROM win"


def _shares(method: str) -> str:
    if method == "equal":
        sh = "1.0::DOUBLE / COUNT(*) OVER (PARTITION BY meter_id)"
    else:
        sh = "CASE WHEN COUNT(*) OVER (PARTITION BY meter_id) = 1 THEN 1.0::DOUBLE ELSE area / SUM(area) OVER (PARTITION BY meter_id) END"
    if method == "gas_share":
        sh = ("CASE WHEN COUNT(*) OVER (PARTITION BY meter_id) = 1 THEN 1.0::DOUBLE WHEN SUM(COALESCE(gu, 0)) OVER (PARTITION BY meter_id) > 0 THEN COALESCE(gu, 0) / SUM(COALESCE(gu, 0)) OVER (PARTITION BY meter_id) "
              "ELSE area / SUM(area) OVER (PARTITION BY meter_id) END")
    return (f"wb AS (SELECT * FROM bills WHERE month IN (SELECT month FROM win)), gs AS (SELECT 'B' || m.k AS building_id, SUM(usage) AS gu FROM wb JOIN meters m USING (meter_id) WHERE m.fuel = 'gas' AND m.k % 3 <> 0 GROUP BY 1), "
            f"sh AS (SELECT s.meter_id, s.fuel, s.building_id, {sh} AS share FROM serves s JOIN buildings USING (building_id) LEFT JOIN gs USING (building_id)), "
            "mu AS (SELECT meter_id, SUM(usage) AS u, COALESCE(SUM(cost_usd), 0) AS c FROM wb GROUP BY 1), "
            "an AS (SELECT building_id, area, rk, COALESCE(SUM(CASE WHEN fuel = 'electricity' THEN u * share END), 0) AS kwh, COALESCE(SUM(CASE WHEN fuel = 'gas' THEN u * share END), 0) AS mcf, "
            "COALESCE(SUM(CASE WHEN fuel = 'electricity' THEN c * share END), 0) AS ec, COALESCE(SUM(CASE WHEN fuel = 'gas' THEN c * share END), 0) AS gc FROM buildings LEFT JOIN (sh JOIN mu USING (meter_id)) USING (building_id) GROUP BY 1, 2, 3), "
            "ax AS (SELECT *, (kwh * 3.412::DOUBLE + mcf * 1037) / area AS eui FROM an)")


for _a in ("area_weighted", "equal", "gas_share"):
    O[f"fuel_annual_{_a}"] = (f"WITH {FU}, {WIN}, {_shares(_a)} SELECT building_id, ROUND(kwh, 3) AS kwh, ROUND(mcf, 3) AS mcf, ROUND(ec, 1) AS elec_cost_usd, ROUND(gc, 1) AS gas_cost_usd, "
                              "ROUND(kwh / area, 3) AS kwh_per_ft2, ROUND(eui, 3) AS site_eui_kbtu_ft2 FROM ax")
O["fuel_campus"] = (f"WITH {FU}, {WIN}, {_shares('area_weighted')} SELECT ROUND(SUM(kwh), 2) AS kwh, ROUND(SUM(mcf), 2) AS mcf, ROUND(SUM(area), 2) AS floor_area_ft2, "
                    "ROUND((SUM(kwh) * 3.412::DOUBLE + SUM(mcf) * 1037) / SUM(area), 2) AS site_eui_kbtu_ft2, ROUND(SUM(ec + gc), 2) AS cost_usd FROM ax")
KB = "CASE WHEN fuel = 'electricity' THEN usage * 3.412::DOUBLE ELSE usage * 1037 END"
MI = "(CAST({0}[1:4] AS INT) * 12 + CAST({0}[6:7] AS INT) - 1)"
MT = "(LPAD(CAST({0} // 12 AS VARCHAR), 4, '0') || '-' || LPAD(CAST({0} % 12 + 1 AS VARCHAR), 2, '0'))"
O["fuel_monthly_gaps"] = (
    f"WITH {FU}, b AS (SELECT * FROM bills WHERE usage > 200000), e AS (SELECT MIN({MI.format('month')}) AS a, MAX({MI.format('month')}) AS z FROM b), "
    f"g AS (SELECT meter_id, fuel, UNNEST(range(e.a, e.z + 1)) AS i FROM meters, e), gm AS (SELECT meter_id, fuel, {MT.format('i')} AS month FROM g) "
    f"SELECT meter_id, month, fuel, ROUND(usage, 2) AS usage, ROUND({KB}, 2) AS kbtu, CASE WHEN usage IS NULL THEN 1 ELSE 0 END AS gap FROM gm LEFT JOIN b USING (meter_id, month)")
STK = f"st AS (SELECT month, fuel, SUM(usage) AS usage, SUM({KB}) AS kbtu, MAX(demand_kw) AS dk FROM bills JOIN meters USING (meter_id) GROUP BY 1, 2)"
O["fuel_stacked"] = f"WITH {FU}, {STK} SELECT month, fuel, ROUND(usage, 2) AS usage, ROUND(kbtu, 2) AS kbtu, ROUND(dk, 2) AS demand_kw FROM st"
O["fuel_intensity"] = (f"WITH {FU}, {STK} SELECT month, CAST(month[1:4] AS INT) AS year, CAST(month[6:7] AS INT) AS mon, fuel, ROUND(kbtu, 2) AS kbtu, ROUND(kbtu / (SELECT SUM(area) FROM buildings), 2) AS intensity_kbtu_ft2 FROM st")
O["fuel_demand_grid"] = (f"WITH {FU} SELECT CAST(month[1:4] AS INT) AS year, " + ", ".join(
    f"ROUND(MAX(demand_kw) FILTER (WHERE month[6:7] = '{m:02d}'), 6) AS m{m:02d}" for m in range(1, 13)) + " FROM bills JOIN meters USING (meter_id) WHERE fuel = 'electricity' GROUP BY 1")
O["fuel_quality"] = (
    f"WITH {FU}, b AS (SELECT * FROM bills WHERE usage > 300000), q AS (SELECT meter_id, COUNT(*) AS c, MIN(month) AS a, MAX(month) AS z, list({MI.format('month')}) AS hv, 100.0::DOUBLE * COUNT(cost_usd) / COUNT(*) AS cc FROM b GROUP BY 1), "
    f"x AS (SELECT *, range({MI.format('a')}, {MI.format('z')} + 1) AS al FROM q) SELECT meter_id, c AS n_months, a AS span_start, z AS span_end, len(al)::INT AS expected_months, "
    f"array_to_string(list_transform(list_filter(al, lambda v: NOT list_contains(hv, v::INT)), lambda v: {MT.format('v')}), ',') AS missing_months, ROUND(100.0::DOUBLE * c / len(al), 6) AS completeness_pct, ROUND(cc, 6) AS cost_coverage_pct FROM x")
O["fuel_weather_fit"] = (
    f"WITH {FU}, {STK}, {DD}, p AS (SELECT fuel, usage AS y, CASE WHEN fuel = 'gas' THEN hdd ELSE cdd END AS x FROM st JOIN ddm USING (month)) "
    "SELECT fuel, COUNT(*) AS n_months, ROUND(regr_slope(y, x), 4) AS slope, ROUND(regr_intercept(y, x), 4) AS intercept, ROUND(regr_r2(y, x), 4) AS r2 FROM p GROUP BY 1 HAVING COUNT(*) >= 6")
_peer = {0: ("office", 34.0, 52.9, 71.0), 1: ("k12_school", 31.0, 48.5, 65.0), 2: ("retail_store", 33.0, 51.4, 69.0), 3: ("hotel", 41.0, 63.0, 85.0), 4: ("commercial_all", 46.0, 70.6, 95.0)}
_pvl = ", ".join(f"({k}, '{t}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (t, a, b, c) in _peer.items())
O["fuel_peer_band"] = (
    f"WITH {FU}, {WIN}, {_shares('area_weighted')}, pr(rk, t, a, b, c) AS (VALUES {_pvl}), v AS (SELECT building_id, eui / 20000 AS e, pr.* FROM ax JOIN pr USING (rk)) "
    "SELECT building_id, t AS peer_type, CASE WHEN rk = 4 THEN 'fallback_commercial_all' ELSE 'exact' END AS matched, CASE WHEN e < a THEN 'below_p20' WHEN e > c THEN 'above_p80' ELSE 'within_band' END AS band, "
    "ROUND(100 * (e - b) / b, 3) AS vs_median_pct FROM v")
O["tidy_bills"] = ("SELECT o_orderpriority AS account, strftime(o_orderdate, '%Y-%m') AS month, ROUND(SUM(o_totalprice), 2) AS usage, ROUND(SUM(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS cost_usd, "
                   "MAX(o_orderkey % 100)::DOUBLE AS demand_kw FROM orders GROUP BY 1, 2")
BINS = ("bn AS (SELECT FLOOR(oa_t / 5) * 5 + 2.5::DOUBLE AS temp_f, " + ", ".join(f"COUNT(*) FILTER (WHERE hour(timestamp_utc) // 8 = {s}) * (300 / 3600.0::DOUBLE) AS shift{s + 1}_h" for s in range(3))
        + " FROM weather WHERE oa_t IS NOT NULL GROUP BY 1)")
O["weather_bins"] = f"WITH {B}, {BINS} SELECT ROUND(temp_f, 6) AS temp_f, " + ", ".join(f"ROUND(shift{s}_h, 6) AS shift{s}_h" for s in (1, 2, 3)) + " FROM bn"
_ws = f"(0.621945::DOUBLE * {psat('temp_f')} / (14.696::DOUBLE - {psat('temp_f')}))"
O["schedule_savings"] = (
    f"WITH {B}, {BINS}, bh AS (SELECT *, 0.24::DOUBLE * temp_f + {_ws} * (1061 + 0.444::DOUBLE * temp_f) AS ho, (shift1_h * 4 / 8 + shift2_h * 8 / 8 + shift3_h * 6 / 8) AS run FROM bn), "
    "m AS (SELECT s_suppkey AS k, 5.0::DOUBLE + s_suppkey % 7 AS fk, 1013.7193::DOUBLE + s_suppkey * 11.3137::DOUBLE AS cfm, 1 - (13.0::DOUBLE * (5 + s_suppkey % 3)) / (18 * 7) AS cut FROM supplier), "
    "x AS (SELECT k, cut, fk * SUM(run) AS fan, SUM(GREATEST(0, 1.08::DOUBLE * cfm * (55 - temp_f) / 1000) * run / 0.8::DOUBLE / 1000) AS heat, SUM(GREATEST(0, cfm * (ho - 23.2::DOUBLE) * 4.5::DOUBLE / 12000) * run * 0.9::DOUBLE) AS cool FROM m, bh GROUP BY k, cut, fk) "
    "SELECT k AS measure_id, ROUND(cut, 4) AS hours_reduction_fraction, ROUND(fan * cut, 4) AS fan_savings_kwh, ROUND(heat * cut, 4) AS heating_savings_mmbtu, ROUND(heat * cut * 10, 4) AS heating_savings_therms, ROUND(cool * cut, 4) AS cooling_savings_kwh FROM x")
O["measure_savings"] = (
    "WITH m AS (SELECT s_suppkey AS k, s_suppkey % 9 AS kd, s_suppkey % 2 = 0 AS gas, ABS(s_acctbal) AS cost, 100.0::DOUBLE + s_suppkey AS a, 10.0::DOUBLE + s_suppkey % 5 AS b, 0.9::DOUBLE AS c, 0.7::DOUBLE AS d, 3.0::DOUBLE AS e, 2.0::DOUBLE AS f FROM supplier), "
    "s AS (SELECT *, CASE kd WHEN 0 THEN a * b * (POW(c, e) - POW(d, e)) WHEN 1 THEN a * (b - c) * d WHEN 3 THEN a * (b - c) WHEN 4 THEN CASE WHEN gas THEN 0 ELSE 1.08::DOUBLE * a * b * c / d / 3412.142::DOUBLE END "
    "WHEN 5 THEN 4.5::DOUBLE * a * b * c / 1e6 * 293.07107::DOUBLE / d WHEN 6 THEN LEAST(a, b) * c * d * e * f WHEN 7 THEN a * b * c * d + e WHEN 8 THEN a * b * c + (d - e) + f ELSE 0 END AS kwh, "
    "CASE WHEN kd = 2 THEN a * 10 / b - a * 10 / c WHEN kd = 4 AND gas THEN 1.08::DOUBLE * a * b * c / d / 1e5 ELSE 0 END AS th FROM m), "
    "u AS (SELECT *, kwh * 0.12::DOUBLE + th * 0.9::DOUBLE AS usd FROM s) SELECT k AS measure_id, ROUND(kwh, 4) AS savings_kwh, ROUND(th, 4) AS savings_therms, ROUND(usd, 4) AS savings_usd, "
    "ROUND(CASE WHEN usd > 0 THEN cost / usd END, 4) AS payback_years, ROUND(-cost + usd * list_sum(list_transform(range(1, 16), lambda y: 1 / POW(1.05::DOUBLE, y))), 4) AS npv_usd FROM u")

# --- findings --------------------------------------------------------------------------------
FR = ["FC1", "FC2", "AHU-SATDEV", "VAV-4", "VAV-5", "VAV-AHU-LEAVE", "CHW-1", "CHW-3", "SV-RANGE", "AHU-DUCTHI", "HP-1"]
RES = results(FR)
SEV = "CASE WHEN rule_id LIKE 'CHW%' THEN 'critical' WHEN rule_id LIKE 'VAV%' THEN 'info' ELSE 'warning' END"
REC = f"{RES}, rec AS (SELECT *, '@SITE@|' || equipment_id || '|' || rule_id AS fault_id, 'confirmed' AS st, {SEV} AS sev FROM res WHERE fault_hours > 0)"
O["fault_summary"] = f"WITH {REC} SELECT 0::BIGINT AS raw_count, COUNT(*) AS confirmed_count, 0::BIGINT AS cleared_count, COUNT(*) AS active_count, COUNT(*) AS total_count FROM rec"
_SNOOZED = "(equipment_id LIKE 'VAV%' AND rule_id = 'VAV-5')"
LIFE = (f"{REC}, life AS (SELECT fault_id, 1 AS episode, CASE WHEN {_SNOOZED} THEN 'cleared' ELSE st END AS status, sev AS severity, '2024-01-10' AS opened_at, "
        f"CASE WHEN {_SNOOZED} THEN '2024-01-10' ELSE '2024-02-01' END AS last_seen_at, CASE WHEN {_SNOOZED} THEN '2024-01-12' END AS cleared_at, "
        f"CASE WHEN {_SNOOZED} THEN 'user' END AS cleared_by FROM rec "
        f"UNION ALL SELECT fault_id, 2, st, sev, '2024-02-01', '2024-02-01', NULL, NULL FROM rec WHERE {_SNOOZED} AND equipment_id LIKE '%1')")
O["fault_lifecycle"] = f"WITH {LIFE} SELECT * FROM life"
O["fault_lifecycle_summary"] = (
    f"WITH {LIFE} SELECT COUNT(*) FILTER (status = 'raw') AS raw_count, COUNT(*) FILTER (status = 'confirmed') AS confirmed_count, "
    "COUNT(*) FILTER (status = 'cleared') AS cleared_count, COUNT(*) FILTER (status <> 'cleared') AS active_count, COUNT(*) AS total_count FROM life")
O["fault_records_cleared"] = f"WITH {REC} SELECT fault_id, st AS status, sev AS severity FROM rec WHERE NOT (equipment_id LIKE 'VAV%' AND rule_id = 'VAV-5' AND equipment_id NOT LIKE '%1')"
SF = f"{B}, fb AS (SELECT *, CASE WHEN {PREDICATES['AHU-SATDEV'][1]} THEN 1 ELSE 0 END AS f FROM history), fi AS ({islands('fb', 'f')}), fl AS (SELECT *, CASE WHEN f = 1 AND len >= 2 THEN 1 ELSE 0 END AS cf FROM fi)"
O["fault_trend"] = f"WITH {SF} SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, COUNT(*) AS raw_fault_samples FROM fl WHERE f = 1 GROUP BY 1"
O["top_faulted"] = f"WITH {REC} SELECT equipment_id, COUNT(*) AS fault_count FROM rec GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
O["fault_families"] = (f"WITH {REC} SELECT rule_id AS family, COUNT(*) AS fault_count, COUNT(DISTINCT equipment_id) AS equipment_count, MIN(sev) AS worst, "
                       "CASE MIN(sev) WHEN 'critical' THEN 'red' WHEN 'warning' THEN 'yellow' ELSE 'green' END AS traffic FROM rec GROUP BY 1")
O["stats_in_and_out_of_fault"] = (f"WITH {SF} SELECT equipment_id, COUNT(sat) AS total_samples, COUNT(sat) FILTER (WHERE cf = 1) AS fault_samples, ROUND(AVG(sat) FILTER (WHERE cf = 1), 6) AS avg_fault, "
                                  "ROUND(AVG(sat) FILTER (WHERE cf = 0), 6) AS avg_normal, ROUND(MIN(sat) FILTER (WHERE cf = 1), 6) AS min_fault, ROUND(MAX(sat) FILTER (WHERE cf = 1), 6) AS max_fault FROM fl GROUP BY 1")
O["fault_intervals"] = (
    f"WITH {SF}, l AS (SELECT equipment_id, MAX(timestamp_utc) AS last FROM history GROUP BY 1), e AS (SELECT equipment_id, sid, MIN(timestamp_utc) AS a, MAX(timestamp_utc) AS z, COUNT(*) AS samples FROM fl WHERE cf = 1 GROUP BY 1, 2) "
    f"SELECT equipment_id, {ts('a', 'start')}, strftime(z, '%Y-%m-%d %H:%M:%S') AS \"end\", samples, CASE WHEN z >= last THEN 1 ELSE 0 END AS open FROM e JOIN l USING (equipment_id)")
O["worst_fault_day"] = (f"WITH {SF}, dc AS (SELECT equipment_id, strftime(timestamp_utc, '%Y-%m-%d') AS dy, COUNT(*) AS c FROM fl WHERE cf = 1 GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY equipment_id ORDER BY c DESC, dy) AS rn FROM dc) "
                        "SELECT equipment_id, dy AS worst_day, c AS samples FROM k WHERE rn = 1")
SYS = ("CASE WHEN kd = 'ahu' THEN 'AHU' WHEN kd = 'heatpump' THEN 'HP' WHEN kd = 'chiller' OR rule_id LIKE 'CHW%' THEN 'CHW' WHEN kd = 'boiler' THEN 'HW' WHEN kd = 'vav' OR rule_id LIKE 'VAV%' OR rule_id LIKE 'SV-%' THEN 'VAV' ELSE UPPER(kd) END")
CAND = (f"{RES}, {B}, sm AS (SELECT equipment_id, COUNT(*) AS c FROM history GROUP BY 1), "
        f"c0 AS (SELECT res.equipment_id, rule_id, fault_hours, fault_hours * 12 / c * 100 AS fault_pct, {KIND.replace('equipment_id', 'res.equipment_id')} AS kd FROM res JOIN sm ON sm.equipment_id = res.equipment_id WHERE fault_hours > 0), "
        f"cand AS (SELECT *, '@SITE@|' || equipment_id || '|' || rule_id AS candidate_key, {SYS} AS system, COUNT(*) OVER (PARTITION BY rule_id) AS peer_count, (SELECT GREATEST(COUNT(DISTINCT equipment_id), 1) FROM c0 WHERE equipment_id LIKE 'VAV%') AS fleet_size FROM c0)")
O["finding_candidates"] = f"WITH {CAND} SELECT candidate_key, system, ROUND(fault_hours, 6) AS fault_hours, ROUND(fault_pct, 6) AS fault_pct, peer_count, fleet_size FROM cand"
ASS = (f"{CAND}, cx AS (SELECT equipment_id, AVG(zone_t) AS mz, MIN(damper_pct) AS dp, MAX(zone_flow) AS af, quantile_cont(duct_static, 0.5) FILTER (WHERE NOT {FOFF}) AS fo, quantile_cont(duct_static, 0.5) FILTER (WHERE {FOFF}) AS fn FROM history GROUP BY 1), "
       "a1 AS (SELECT cand.*, mz, dp, af, fo, fn, rule_id IN ('AHU-DUCTHI','FC1') AS duct, fault_pct >= 95 AS near, peer_count >= GREATEST(5, FLOOR(fleet_size * 0.4)) AS common, COALESCE(mz < 40, FALSE) AS cold, "
       "rule_id = 'VAV-5' AND COALESCE(dp <= 5 AND af >= 50, FALSE) AS bias, rule_id = 'VAV-5' AND COALESCE(dp <= 5 AND af < 5, FALSE) AS absent, "
       "rule_id IN ('AHU-DUCTHI','FC1') AND COALESCE(fn > 0 AND fo >= GREATEST(1, 2 * fn), FALSE) AS stb, COUNT(*) OVER (PARTITION BY cand.equipment_id) AS al, "
       "COUNT(*) FILTER (WHERE rule_id NOT IN ('AHU-DUCTHI','FC1')) OVER (PARTITION BY cand.equipment_id) AS pl FROM cand JOIN cx ON cx.equipment_id = cand.equipment_id), "
       "a2 AS (SELECT *, CASE WHEN stb OR bias THEN 20 ELSE 0 END AS tele, LEAST(15, LEAST(15, 5 * (CASE WHEN duct THEN al ELSE pl END - 1)) + CASE WHEN stb THEN 10 ELSE 0 END) AS corr FROM a1), "
       "a3 AS (SELECT *, near AND rule_id LIKE 'CHW%' AND tele < 10 AS chw FROM a2), "
       "a4 AS (SELECT *, GREATEST(0, LEAST(100, 30 + CASE WHEN chw THEN 5 ELSE 10 END + tele + LEAST(10, fault_hours / 200) + corr + CASE WHEN absent THEN -20 ELSE 0 END + CASE WHEN near THEN -5 ELSE 0 END "
       "+ CASE WHEN common THEN -15 ELSE 0 END + CASE WHEN chw THEN -10 ELSE 0 END)) AS sc FROM a3), "
       "a5 AS (SELECT *, CASE WHEN sc >= 80 THEN 'STRONGLY_SUPPORTED' WHEN sc >= 60 THEN 'PROBABLE' WHEN sc >= 40 THEN 'INCONCLUSIVE' WHEN sc >= 20 THEN 'LIKELY_FALSE_POSITIVE' ELSE 'DATA_QUALITY' END AS gr FROM a4), "
       f"ass AS (SELECT *, {half_up('CASE WHEN cold THEN 5 ELSE sc END', 1)} AS score, CASE WHEN cold THEN 'DATA_QUALITY' WHEN near AND tele < 10 AND corr < 5 THEN CASE WHEN sc >= 40 THEN 'INCONCLUSIVE' ELSE 'LIKELY_FALSE_POSITIVE' END "
       "WHEN absent AND tele <= 0 THEN 'LIKELY_FALSE_POSITIVE' WHEN near AND gr = 'STRONGLY_SUPPORTED' AND tele < 15 THEN 'PROBABLE' ELSE gr END AS classification, CASE WHEN cold THEN FALSE ELSE near OR common END AS cmode FROM a5)")
O["finding_scores"] = f"WITH {ASS} SELECT candidate_key, score, classification, cmode::INT AS common_mode FROM ass"
CL = ("cl AS (SELECT *, CASE WHEN classification = 'DATA_QUALITY' THEN 'dq|@SITE@|' || equipment_id || '|' || rule_id WHEN cmode AND rule_id LIKE 'VAV%' THEN 'common|@SITE@|' || rule_id WHEN cmode AND rule_id LIKE 'CHW%' THEN 'chw|@SITE@|' || rule_id "
      "WHEN rule_id IN ('VAV-4','VAV-5','VAV-7','SV-RANGE') THEN 'vavflow|@SITE@|' || equipment_id ELSE 'solo|@SITE@|' || equipment_id || '|' || rule_id END AS cluster, "
      "CASE classification WHEN 'STRONGLY_SUPPORTED' THEN 5 WHEN 'PROBABLE' THEN 4 WHEN 'DATA_QUALITY' THEN 3 WHEN 'INCONCLUSIVE' THEN 2 WHEN 'LIKELY_FALSE_POSITIVE' THEN 1 ELSE 0 END AS rk FROM ass), "
      "cg AS (SELECT cluster, MAX(score) AS score, arg_max(classification, {'s': score, 'r': rk}) AS classification, COUNT(*) AS members, COUNT(DISTINCT equipment_id) AS equipment_count, COUNT(DISTINCT rule_id) AS rule_count, SUM(fault_hours) AS fault_hours "
      "FROM cl WHERE classification NOT IN ('LIKELY_FALSE_POSITIVE','NOT_ACTIONABLE') GROUP BY 1 HAVING arg_max(classification, {'s': score, 'r': rk}) <> 'DATA_QUALITY' OR MAX(score) >= 10)")
O["finding_clusters"] = f"WITH {ASS}, {CL} SELECT cluster, score, classification, members, equipment_count, rule_count, ROUND(fault_hours, 6) AS fault_hours FROM cg"
TOP = ("tp AS (SELECT ROW_NUMBER() OVER (ORDER BY CASE classification WHEN 'STRONGLY_SUPPORTED' THEN 5 WHEN 'PROBABLE' THEN 4 WHEN 'DATA_QUALITY' THEN 3 WHEN 'INCONCLUSIVE' THEN 2 ELSE 1 END DESC, score DESC, cluster) AS priority, * FROM cg)")
O["finding_priority"] = f"WITH {ASS}, {CL}, {TOP} SELECT priority::INT AS priority, cluster, score, classification, members FROM tp WHERE priority <= 7"
O["fault_inventory"] = (f"WITH {ASS}, {CL}, {TOP}, iv AS (SELECT cl.rule_id, cl.fault_hours, cl.classification NOT IN ('LIKELY_FALSE_POSITIVE','NOT_ACTIONABLE') AND tp.cluster IS NOT NULL AS inn FROM cl LEFT JOIN (SELECT * FROM tp WHERE priority <= 7) tp ON cl.cluster = tp.cluster) "
                        "SELECT rule_id, COUNT(*) AS fault_count, ROUND(SUM(fault_hours), 6) AS fault_hours, COUNT(*) FILTER (WHERE inn) AS in_priority FROM iv GROUP BY 1")
O["finding_scope"] = f"WITH {CAND} SELECT candidate_key, system FROM cand WHERE system IN ('VAV', 'CHW') AND rule_id <> 'SV-RANGE'"


def _listing() -> str:
    from thermaline.operators.rules import RULES
    v = ", ".join(f"('{r}', '{','.join(RULES[r].kinds)}', {RULES[r].confirm})" for r in FR)
    return f"WITH {RES}, rd(rule_id, equipment_kinds, confirm_seconds) AS (VALUES {v}) SELECT rule_id, equipment_kinds, confirm_seconds, status, COUNT(*) AS n FROM res JOIN rd USING (rule_id) GROUP BY ALL"


O["results_listing"] = _listing()
O["top_fault_rules"] = f"WITH {RES} SELECT rule_id, ROUND(SUM(fault_hours), 6) AS fault_hours FROM res WHERE status = 'FAULT' GROUP BY 1 ORDER BY SUM(fault_hours) DESC, rule_id LIMIT 5"


def _delta() -> str:
    r = rule_sql()
    t = dict(r)
    t["FC2"] = r["FC2"].replace("len >= 2", "len >= 12")
    t["CHW-3"] = r["CHW-3"].replace("ABS(chw_supply_t - chw_supply_sp) > 2.2", "ABS(chw_supply_t - chw_supply_sp) > 6")
    st = lambda q: " UNION ALL ".join(f"SELECT CASE WHEN fault_hours > 0 THEN 'FAULT' ELSE 'PASS' END AS status FROM ({q[i]})" for i in FR)
    return (f"WITH b AS (SELECT status, COUNT(*) AS n FROM ({st(r)}) GROUP BY 1), t AS (SELECT status, COUNT(*) AS n FROM ({st(t)}) GROUP BY 1) "
            "SELECT COALESCE(b.status, t.status) AS status, COALESCE(b.n, 0) AS baseline, COALESCE(t.n, 0) AS tuned, COALESCE(t.n, 0) - COALESCE(b.n, 0) AS delta FROM b FULL OUTER JOIN t ON b.status = t.status")


O["tuning_delta"] = _delta()
O["tuning_hints"] = (f"WITH {results(['SV-STALE', 'SV-FLATLINE', 'FC1', 'VAV-5'])} SELECT COUNT(*) FILTER (WHERE status = 'FAULT') AS faults, "
                     "COUNT(*) FILTER (WHERE status = 'FAULT' AND rule_id LIKE 'SV-%') AS stale_flatline_faults, "
                     "CASE WHEN COUNT(*) FILTER (WHERE status = 'FAULT' AND rule_id LIKE 'SV-%') >= 0.35 * COUNT(*) FILTER (WHERE status = 'FAULT') THEN 1 ELSE 0 END AS stale_dominates, 0::BIGINT AS missing_role_skips FROM res")
