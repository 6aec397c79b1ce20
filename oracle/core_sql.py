"""SQL oracles for the confirmation, alignment, ingest, sensor and topology queries."""

from __future__ import annotations

from oracle.rules_sql import EQW, PREDICATES, base_ctes, fan, n, n0, rule_sql
from thermaline.operators.rules import RULES
from thermaline.sources.driver_tables import RAW_HISTORY_SQL

B = base_ctes()
RAW = f"raw AS ({RAW_HISTORY_SQL})"
T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"
RW = "PARTITION BY equipment_id ORDER BY timestamp_utc, event_id"
DBL = "CAST({} AS DOUBLE)"


def ts(c, name=None):
    return T.format(c, name or c)


def half_up(x, k):
    """Round the decimal reading of a double, ties away from zero."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28, 10)), {k}) AS DOUBLE)"


def sec(c):
    return f"(epoch_us({c}) / 1000000.0::DOUBLE)"


def islands(src: str, flag: str, order: str = "timestamp_utc", keys: str = "equipment_id") -> str:
    """CTE body: rows of `src` with streak id and position."""
    w = f"PARTITION BY {keys} ORDER BY {order}"
    return (f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys}, sid ORDER BY {order}) AS len FROM ("
            f"SELECT *, SUM(fresh) OVER ({w} ROWS UNBOUNDED PRECEDING) AS sid FROM ("
            f"SELECT *, CASE WHEN {flag} = LAG({flag}) OVER ({w}) THEN 0 ELSE 1 END AS fresh FROM {src}))")


O: dict[str, str] = {}
O["confirm_rows_raw"] = (
    f"WITH {RAW}, b AS (SELECT *, CASE WHEN value > 60 THEN 1 ELSE 0 END AS f FROM raw), i AS ({islands('b', 'f', 'timestamp_utc, event_id')}) "
    "SELECT equipment_id, SUM(CASE WHEN f = 1 AND len >= 2 THEN 1 ELSE 0 END)::BIGINT AS confirmed, COUNT(*) AS samples FROM i GROUP BY 1")
DT = (f"{RAW}, d0 AS (SELECT *, {sec('LEAD(timestamp_utc) OVER (' + RW + ')')} - {sec('timestamp_utc')} AS g FROM raw), "
      "med AS (SELECT equipment_id, quantile_cont(g, 0.5) AS m FROM d0 GROUP BY 1), "
      "b AS (SELECT d0.*, COALESCE(g, m, 300) AS dt, CASE WHEN value > 60 THEN 1 ELSE 0 END AS f FROM d0 JOIN med USING (equipment_id))")
O["confirm_elapsed"] = (
    f"WITH {DT}, i AS ({islands('b', 'f', 'timestamp_utc, event_id')}), c AS (SELECT *, SUM(dt) OVER (PARTITION BY equipment_id, sid ORDER BY timestamp_utc, event_id "
    "ROWS UNBOUNDED PRECEDING) AS cum FROM i) SELECT equipment_id, SUM(CASE WHEN f = 1 AND cum >= 7200 THEN 1 ELSE 0 END)::BIGINT AS confirmed FROM c GROUP BY 1")
O["elapsed_hours"] = f"WITH {DT} SELECT equipment_id, ROUND(SUM(f * dt) / 3600, 4) AS hours FROM b GROUP BY 1"
O["confirm_episodes"] = (
    f"WITH {RAW}, b AS (SELECT *, CASE WHEN value > 60 THEN 1 ELSE 0 END AS f FROM raw), i AS ({islands('b', 'f', 'timestamp_utc, event_id')}), "
    "e AS (SELECT equipment_id, sid, MIN(timestamp_utc) AS a, MAX(timestamp_utc) AS z, COUNT(*) AS samples FROM i WHERE f = 1 GROUP BY 1, 2), "
    "l AS (SELECT equipment_id, MAX(timestamp_utc) AS last FROM raw GROUP BY 1) "
    f"SELECT equipment_id, {ts('a', 'start')}, {ts('z', 'end').replace('AS end', 'AS \"end\"')}, samples, ROUND({sec('z')} - {sec('a')}, 3) AS duration_s, "
    f"CASE WHEN z >= last THEN 1 ELSE 0 END AS open FROM e JOIN l USING (equipment_id) WHERE {sec('z')} - {sec('a')} >= 1800")
O["forward_dt_hours"] = (
    f"WITH {RAW}, q AS (SELECT equipment_id, {sec('LEAD(timestamp_utc) OVER (' + RW + ')')} - {sec('timestamp_utc')} AS g FROM raw), d AS (SELECT equipment_id, CASE WHEN g IS NULL THEN 0 ELSE GREATEST(0, LEAST(3600, g)) END AS dt FROM q) "
    "SELECT equipment_id, ROUND(SUM(dt) / 3600, 4) AS hours, ROUND(MAX(dt), 4) AS longest_s FROM d GROUP BY 1")
O["hours_under_mask"] = (
    f"WITH {RAW}, m AS (SELECT equipment_id, timestamp_utc, MAX(CASE WHEN is_on THEN 1 ELSE 0 END) AS f FROM raw GROUP BY 1, 2), "
    f"q AS (SELECT *, {sec('LEAD(timestamp_utc) OVER (' + EQW + ')')} - {sec('timestamp_utc')} AS g FROM m), d AS (SELECT *, CASE WHEN g IS NULL THEN 0 ELSE GREATEST(0, LEAST(7200, g)) END AS dt FROM q) "
    "SELECT equipment_id, ROUND(SUM(f * dt) / 3600, 4) AS hours FROM d GROUP BY 1")
O["startup_delay"] = (
    f"WITH {B}, b AS (SELECT equipment_id, timestamp_utc, CASE WHEN fan_status > 0.05 THEN 1 ELSE 0 END AS f FROM history), i AS ({islands('b', 'f')}) "
    "SELECT equipment_id, SUM(CASE WHEN f = 1 AND len >= 2 THEN 1 ELSE 0 END)::BIGINT AS active_samples FROM i GROUP BY 1")
O["infer_poll"] = (
    f"WITH {RAW}, d AS (SELECT equipment_id, {sec('timestamp_utc')} - {sec('LAG(timestamp_utc) OVER (' + RW + ')')} AS g FROM raw) "
    "SELECT equipment_id, ROUND(CASE WHEN quantile_cont(g, 0.5) > 0 THEN quantile_cont(g, 0.5) ELSE 300 END, 3) AS poll_seconds FROM d GROUP BY 1")
O["confirmed_series_fc1"] = (
    f"WITH {B}, b AS (SELECT *, CASE WHEN {PREDICATES['FC1'][1]} THEN 1 ELSE 0 END AS f FROM history), i AS ({islands('b', 'f')}) "
    f"SELECT equipment_id, {ts('timestamp_utc')}, ROUND(duct_static, 6) AS duct_static, ROUND(duct_static_sp, 6) AS duct_static_sp, ROUND(fan_cmd, 6) AS fan_cmd, "
    "f AS raw_fault, CASE WHEN f = 1 AND len >= 1 THEN 1 ELSE 0 END AS confirmed FROM i")
_st = (f"CASE WHEN fa AND ht AND NOT cl THEN 1 WHEN fa AND NOT ht AND NOT cl AND ec THEN 2 WHEN fa AND NOT ht AND cl AND ec THEN 3 "
       "WHEN fa AND NOT ht AND cl AND NOT ec THEN 4 ELSE 0 END")
O["mode_stable"] = (
    f"WITH {B}, q AS (SELECT equipment_id, timestamp_utc, {n0('fan_cmd')} > 0.01 AS fa, {n0('htg_valve_pct')} > 0.01 AS ht, {n0('clg_valve_pct')} > 0.01 AS cl, "
    f"{n0('oa_damper_pct')} > 0.05 AS ec FROM history), s AS (SELECT *, {_st} AS op_state FROM q), "
    f"c AS (SELECT *, CASE WHEN op_state <> LAG(op_state) OVER ({EQW}) THEN 1 ELSE 0 END AS chg FROM s), "
    f"r AS (SELECT *, MAX(chg) OVER ({EQW} ROWS 2 PRECEDING) AS recent FROM c) "
    "SELECT equipment_id, op_state, SUM(CASE WHEN recent = 0 THEN 1 ELSE 0 END)::BIGINT AS stable, COUNT(*) AS samples FROM r GROUP BY 1, 2")

# --- status ladder ---------------------------------------------------------------------------
def on(r):
    return f"COALESCE((CASE WHEN {r} > 1.5 THEN {r} / 100 ELSE {r} END) > 0.05, FALSE)"


def first_mapped(roles, otherwise):
    return "CASE " + " ".join(f"WHEN has_{r} THEN {on(r)}" for r in roles) + f" ELSE {otherwise} END"


PUMPS = ["pump_status", "chw_pump_status", "chiller_status", "compressor_status", "chiller_current", "chiller_amps",
         "chiller_power", "chw_flow", "chw_pump_cmd"]
COMP = ["compressor_status", "fan_status", "fan_cmd"]
FANG = f"CASE WHEN has_fan_status THEN {on('fan_status')} WHEN has_fan_cmd THEN {on('fan_cmd')} WHEN has_zone_flow THEN COALESCE(zone_flow > 50, FALSE) ELSE NULL END"
GATE_SQL = {"fan": FANG, "hydro": f"COALESCE({first_mapped(PUMPS, 'NULL')}, FALSE)", "comp": first_mapped(COMP, "NULL"),
            "energized": f"COALESCE({FANG}, {first_mapped(PUMPS, 'NULL')}, {first_mapped(COMP, 'NULL')})"}
# rule: gate, delay rows at 300 s
BATCH = {"FC1": ("fan", 1), "FC2": ("fan", 2), "FC13-SAT-HIGH": ("fan", 2), "AHU-SATDEV": ("fan", 2), "AHU-SIMUL": ("fan", 1),
         "ECON-1": ("fan", 2), "VAV-2": (None, 0), "VAV-5": ("fan", 1), "VAV-6": ("fan", 1), "CHW-1": ("hydro", 3), "CHW-3": ("hydro", 2),
         "CW-OPT-1": ("hydro", 2), "HP-1": ("comp", 2), "SV-RANGE": ("energized", 1), "TRIM-3": ("hydro", 2), "MECH-OAT-1": (None, 0)}
KIND = ("CASE WHEN equipment_id LIKE '%WEATHER%' THEN 'weather' WHEN equipment_id LIKE '%VAV%' THEN 'vav' WHEN equipment_id LIKE '%ZONE%' THEN 'zone' "
        "WHEN equipment_id LIKE '%AHU%' THEN 'ahu' WHEN equipment_id LIKE '%TOWER%' THEN 'cooling_tower' WHEN equipment_id LIKE '%CHILLER%' THEN 'chiller' "
        "WHEN equipment_id LIKE '%BOILER%' THEN 'boiler' WHEN equipment_id LIKE '%HEATPUMP%' THEN 'heatpump' WHEN equipment_id LIKE '%METER%' THEN 'meter' ELSE 'unknown' END")


def _batch() -> str:
    has = ", ".join(f"COUNT({r}) OVER (PARTITION BY equipment_id) > 0 AS has_{r}" for r in dict.fromkeys(["fan_status", "fan_cmd", "zone_flow", *PUMPS, *COMP]))
    parts = []
    for r, (gate, delay) in BATCH.items():
        rows, pred = PREDICATES[r]
        g = GATE_SQL[gate] if gate else "TRUE"
        req = RULES[r].required
        cov = " OR ".join(f"MIN(cov_{x}) <= 0" for x in req) or "FALSE"
        covs = "".join(f", COUNT({x}) OVER (PARTITION BY equipment_id) AS cov_{x}" for x in req)
        hydro = f"WHEN NOT MAX(CASE WHEN {' OR '.join('has_' + p for p in PUMPS)} THEN 1 ELSE 0 END)::BOOLEAN THEN 'SKIPPED_MISSING_ROLES'" if gate == "hydro" else ""
        off = "WHEN 100.0 * SUM(act) < 5 * COUNT(*) THEN 'SKIPPED_EQUIPMENT_OFF'" if gate else ""
        kinds = ", ".join(f"'{k}'" for k in RULES[r].kinds)
        parts.append(
            f"(WITH g AS (SELECT *{covs}, ({g}) IS NULL AS free, CASE WHEN {g} THEN 1 ELSE 0 END AS ga, CASE WHEN {pred} THEN 1 ELSE 0 END AS rw FROM h), "
            f"ig AS ({islands('g', 'ga')}), act AS (SELECT * EXCLUDE (sid, len, fresh), CASE WHEN free OR (ga = 1 AND len >= {max(1, delay)}) THEN 1 ELSE 0 END AS act FROM ig), "
            f"f AS (SELECT *, rw * act AS f FROM act), i AS ({islands('f', 'f')}), "
            f"s AS (SELECT equipment_id, SUM(CASE WHEN f = 1 AND len >= {rows} THEN 1 ELSE 0 END) AS nf, SUM(act) AS na, "
            f"CASE WHEN {KIND.replace('equipment_id', 'ANY_VALUE(equipment_id)')} NOT IN ({kinds}) THEN 'NOT_APPLICABLE_EQUIPMENT_TYPE' WHEN {cov} THEN 'SKIPPED_MISSING_ROLES' {hydro} {off} "
            f"WHEN SUM(CASE WHEN f = 1 AND len >= {rows} THEN 1 ELSE 0 END) > 0 THEN 'FAULT' ELSE 'PASS' END AS status FROM i GROUP BY equipment_id) "
            f"SELECT equipment_id, {KIND} AS kind, '{r}' AS rule_id, status, CASE WHEN status IN ('FAULT','PASS') THEN ROUND(nf * 300 / 3600.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS fault_hours, "
            f"CASE WHEN status IN ('FAULT','PASS') THEN ROUND(COALESCE(100.0::DOUBLE * nf / NULLIF(na, 0), 0), 6) ELSE 0.0::DOUBLE END AS fault_pct, na::BIGINT AS active_samples FROM s)")
    return f"WITH {B}, h AS (SELECT *, {has} FROM history) " + " UNION ALL ".join(parts)


O["run_batch_statuses"] = _batch()
def _tuned() -> str:
    r = rule_sql()
    limit = "(CASE WHEN equipment_id = 'AHU_1' AND building_id = 'B2' THEN 2 WHEN building_id = 'B2' THEN 9 ELSE 7 END)"
    rows = "(CASE WHEN building_id = 'B1' THEN 3 ELSE 6 END)"
    sat = r["AHU-SATDEV"].replace("ABS(sat - sat_sp) > 5", f"ABS(sat - sat_sp) > {limit}")
    fc2 = r["FC2"].replace("base AS (SELECT equipment_id,", "base AS (SELECT building_id, equipment_id,").replace("len >= 2", f"len >= {rows}")
    return " UNION ALL ".join(f"SELECT equipment_id, '{i}' AS rule_id, CASE WHEN fault_hours > 0 THEN 'FAULT' ELSE 'PASS' END AS status, fault_hours FROM ({q})"
                              for i, q in (("FC2", fc2), ("AHU-SATDEV", sat), ("FC1", r["FC1"])))


O["rules_tuned_by_layer"] = _tuned()
O["simple_rule"] = f"WITH {B} SELECT equipment_id, SUM(CASE WHEN sat > 90 THEN 1 ELSE 0 END)::BIGINT AS fault_samples FROM history GROUP BY 1"
O["custom_rule"] = (
    f"WITH {B}, b AS (SELECT equipment_id, timestamp_utc, CASE WHEN sat - sat_sp > 10 AND fan_status > 0.5 THEN 1 ELSE 0 END AS f FROM history), i AS ({islands('b', 'f')}) "
    "SELECT equipment_id, SUM(CASE WHEN f = 1 AND len >= 3 THEN 1 ELSE 0 END)::BIGINT AS confirmed FROM i GROUP BY 1")
O["custom_mask_python"] = f"WITH {B} SELECT equipment_id, SUM(CASE WHEN sat > 90 AND COALESCE(fan_cmd, 0) > 10 THEN 1 ELSE 0 END)::BIGINT AS fault_samples FROM history GROUP BY 1"
O["rolling_zscore"] = (
    f"WITH {B}, w AS (SELECT equipment_id, (elec_power - AVG(elec_power) OVER ({EQW} ROWS 11 PRECEDING)) / NULLIF(STDDEV_SAMP(elec_power) OVER ({EQW} ROWS 11 PRECEDING), 0) AS z FROM history) "
    "SELECT equipment_id, SUM(CASE WHEN ABS(z) > 2 THEN 1 ELSE 0 END)::BIGINT AS fault_samples, ROUND(MAX(z), 4) AS max_z FROM w GROUP BY 1")
_bounds = {"zone_t": (40, 100), "oa_t": (-40, 130), "hw_supply_t": (60, 220), "chw_return_t": (32, 90), "fan_cmd": (0, 100), "damper_pct": (0, 100)}


def _assess() -> str:
    parts = []
    for r in ["zone_t", "oa_t", "hw_supply_t", "chw_return_t", "fan_cmd", "damper_pct"]:
        lo, hi = _bounds[r]
        parts.append(f"SELECT equipment_id, '{r}' AS role, CASE WHEN {r} IS NULL THEN 'NULL' WHEN {r} IN (999, 888, -999, 9999, -9999) THEN 'SENTINEL' "
                     f"WHEN {r} < {lo} OR {r} > {hi} THEN 'OUT_OF_RANGE' END AS reason FROM history")
    words = "('occupied','unoccupied','occ','unocc','true','false','on','off','yes','no')"
    parts.append(f"SELECT equipment_id, 'occ_mode', CASE WHEN occ_mode IS NULL THEN 'NULL' WHEN TRY_CAST(occ_mode AS DOUBLE) IS NULL AND LOWER(TRIM(occ_mode)) NOT IN {words} "
                 "THEN 'NON_NUMERIC' END FROM history")
    k = lambda x: f"SUM(CASE WHEN reason = '{x}' THEN 1 ELSE 0 END)::BIGINT"
    return (f"WITH {B}, l AS ({' UNION ALL '.join(parts)}) SELECT equipment_id, role, COUNT(*) AS samples, COUNT(*) - COUNT(reason) AS valid_samples, "
            f"{k('NULL')} AS \"null\", {k('SENTINEL')} AS sentinel, {k('NON_NUMERIC')} AS non_numeric, {k('OUT_OF_RANGE')} AS out_of_range, 0::BIGINT AS impossible_for_role, "
            "ROUND((COUNT(*) - COUNT(reason)) / COUNT(*)::DOUBLE, 4) AS valid_coverage, "
            f"ROUND((COUNT(*) - COUNT(reason)) / COUNT(*)::DOUBLE * (1 - 0.5 * {k('SENTINEL')} / COUNT(*)::DOUBLE), 4) AS confidence FROM l GROUP BY 1, 2")


O["assess_quality"] = _assess()
O["apply_normalized"] = (
    f"WITH {B} SELECT equipment_id, COUNT(CASE WHEN hw_supply_t BETWEEN 60 AND 220 THEN 1 END) AS n_hw_supply_t, "
    "COUNT(CASE WHEN damper_pct BETWEEN 0 AND 100 THEN 1 END) AS n_damper_pct, COUNT(CASE WHEN chw_return_t BETWEEN 32 AND 90 THEN 1 END) AS n_chw_return_t FROM history GROUP BY 1")
_satdev9 = rule_sql()["AHU-SATDEV"].replace("ABS(sat - sat_sp) > 5", "ABS(sat - sat_sp) > 9")


def _compare() -> str:
    r = rule_sql()
    tag = lambda q, i: f"SELECT equipment_id, '{i}' AS rule_id, fault_hours FROM ({q})"
    a = " UNION ALL ".join(tag(r[i], i) for i in ("FC1", "AHU-SATDEV", "VAV-5"))
    b = " UNION ALL ".join([tag(r["FC1"], "FC1"), tag(_satdev9, "AHU-SATDEV"), tag(r["VAV-5"], "VAV-5")])
    c = lambda o: f"SUM(CASE WHEN o = '{o}' THEN 1 ELSE 0 END)::BIGINT AS {o if o != 'pass' else 'pass'}"
    return (f"WITH a AS ({a}), b AS ({b}), j AS (SELECT COALESCE(a.rule_id, b.rule_id) AS rule_id, ABS(a.fault_hours - b.fault_hours) AS d, "
            "CASE WHEN b.rule_id IS NULL THEN 'left_only' WHEN a.rule_id IS NULL THEN 'right_only' WHEN ABS(a.fault_hours - b.fault_hours) <= 0.5 THEN 'pass' ELSE 'fail' END AS o "
            "FROM a FULL OUTER JOIN b ON a.rule_id = b.rule_id AND a.equipment_id = b.equipment_id) "
            f"SELECT rule_id, {c('pass')}, {c('fail')}, {c('left_only')}, {c('right_only')}, ROUND(MAX(d), 6) AS max_abs_delta FROM j GROUP BY 1")


O["compare_results"] = _compare()

# --- alignment -------------------------------------------------------------------------------
SIDES = (f"{RAW}, l AS (SELECT equipment_id, timestamp_utc, event_id, value AS left_value FROM raw WHERE event_type = 'view'), "
         "r AS (SELECT equipment_id, timestamp_utc, value AS right_value FROM raw WHERE event_type = 'purchase')")
HR = "date_trunc('hour', {})"
O["join_exact_hour"] = (
    f"WITH {SIDES}, r1 AS (SELECT equipment_id, {HR.format('timestamp_utc')} AS h, arg_max(right_value, timestamp_utc) AS right_value FROM r GROUP BY 1, 2) "
    f"SELECT event_id, ROUND(left_value, 6) AS left_value, ROUND(right_value, 6) AS right_value FROM l LEFT JOIN r1 ON l.equipment_id = r1.equipment_id AND {HR.format('l.timestamp_utc')} = r1.h")
O["join_asof_previous"] = (
    f"WITH {SIDES} SELECT event_id, ROUND(left_value, 6) AS left_value, ROUND(right_value, 6) AS right_value FROM l ASOF LEFT JOIN r "
    "ON l.equipment_id = r.equipment_id AND l.timestamp_utc >= r.timestamp_utc")
O["join_floor_hour"] = (
    f"WITH {SIDES}, r1 AS (SELECT {HR.format('timestamp_utc')} AS h, arg_max(right_value, timestamp_utc) AS right_value FROM r GROUP BY 1), "
    f"l1 AS (SELECT *, {HR.format('timestamp_utc')} AS lh FROM l) "
    "SELECT event_id, ROUND(left_value, 6) AS left_value, ROUND(right_value, 6) AS right_value FROM l1 ASOF LEFT JOIN r1 ON l1.lh >= r1.h")
WXH = f"wh AS (SELECT {HR.format('timestamp_utc')} AS h, arg_max(oa_t, timestamp_utc) AS oa_t, arg_max(oa_h, timestamp_utc) AS oa_h FROM weather GROUP BY 1)"
O["join_weather_15m"] = (
    f"WITH {B}, {SIDES}, {WXH}, l1 AS (SELECT *, {HR.format('timestamp_utc')} AS lh FROM l) "
    "SELECT event_id, ROUND(oa_t, 6) AS oa_t, ROUND(oa_h, 6) AS oa_h FROM l1 ASOF LEFT JOIN wh ON l1.lh >= wh.h")
O["resample_kw_hourly"] = (
    f"WITH {B}, {SIDES}, {WXH}, k AS (SELECT {HR.format('timestamp_utc')} AS lh, {half_up('SUM(left_value) / COUNT(left_value)', 4)} AS v FROM l GROUP BY 1) "
    f"SELECT {ts('lh', 'timestamp_utc')}, {half_up('v', 3)} AS left_value, ROUND(oa_t, 6) AS oa_t FROM k ASOF LEFT JOIN wh ON k.lh >= wh.h")
GAPPY = f"{RAW}, g AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN value END AS reading FROM raw)"
_made = "CASE WHEN reading IS NULL AND filled IS NOT NULL THEN 1 ELSE 0 END AS fill_created"
O["fill_forward"] = (f"WITH {GAPPY}, f AS (SELECT *, LAST_VALUE(reading IGNORE NULLS) OVER ({RW} ROWS UNBOUNDED PRECEDING) AS filled FROM g) "
                     f"SELECT event_id, ROUND(COALESCE(reading, filled), 3) AS reading, {_made} FROM f")
O["fill_backward"] = (f"WITH {GAPPY}, f AS (SELECT *, FIRST_VALUE(reading IGNORE NULLS) OVER ({RW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM g) "
                      f"SELECT event_id, ROUND(COALESCE(reading, filled), 3) AS reading, {_made} FROM f")
O["fill_linear"] = (
    f"WITH {GAPPY}, n AS (SELECT *, ROW_NUMBER() OVER ({RW}) AS i FROM g), "
    "q AS (SELECT *, CASE WHEN reading IS NOT NULL THEN i END AS ri FROM n), "
    f"p AS (SELECT *, LAST_VALUE(reading IGNORE NULLS) OVER ({RW} ROWS UNBOUNDED PRECEDING) AS a, LAST_VALUE(ri IGNORE NULLS) OVER ({RW} ROWS UNBOUNDED PRECEDING) AS ai, "
    f"FIRST_VALUE(reading IGNORE NULLS) OVER ({RW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z, "
    f"FIRST_VALUE(ri IGNORE NULLS) OVER ({RW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS zi FROM q), "
    f"f AS (SELECT *, CASE WHEN reading IS NULL AND a IS NOT NULL AND z IS NOT NULL THEN {half_up('a + (z - a) * ((i - ai)::DOUBLE / (zi - ai)::DOUBLE)', 4)} END AS filled FROM p) "
    f"SELECT event_id, {half_up('COALESCE(reading, filled)', 3)} AS reading, {_made} FROM f")
O["fill_constant"] = f"WITH {GAPPY} SELECT event_id, ROUND(reading, 3) AS reading, 0 AS fill_created FROM g"
O["site_oat_by_ts"] = (f"WITH {B}, s AS (SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t IS NOT NULL GROUP BY 1) "
                       "SELECT equipment_id, ROUND(AVG(oa_t - oat_f), 6) AS mean_offset, COUNT(oat_f) AS n FROM history LEFT JOIN s USING (timestamp_utc) GROUP BY 1")
O["site_oat_with_fallback"] = (
    f"WITH {B}, wx AS (SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t BETWEEN 40 AND 110 AND UPPER(equipment_id) LIKE '%WEATHER%' GROUP BY 1), "
    "fb AS (SELECT timestamp_utc, AVG(oa_t) AS oat_f FROM history WHERE oa_t BETWEEN 40 AND 110 GROUP BY 1) "
    f"SELECT {ts('timestamp_utc')}, ROUND(oat_f, 6) AS oat_f FROM (SELECT * FROM wx UNION ALL SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM wx)) u")
O["weather_equi_join"] = (f"WITH {B}, wx AS (SELECT timestamp_utc, MAX(oa_t) AS o, MAX(web_oa_t) AS w FROM weather GROUP BY 1) "
                          "SELECT equipment_id, ROUND(AVG(o), 6) AS mean_wx, COUNT(w) AS n_web FROM history LEFT JOIN wx USING (timestamp_utc) GROUP BY 1")

# --- shape and ingest ------------------------------------------------------------------------
_l4 = " UNION ALL ".join(f"SELECT equipment_id, '{r}' AS role, {r} AS value FROM history WHERE {r} IS NOT NULL" for r in ("sat", "mat", "zone_t", "fan_cmd"))
O["wide_to_long"] = f"WITH {B}, l AS ({_l4}) SELECT equipment_id, role, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM l GROUP BY 1, 2"
_pv = ", ".join(f"ROUND(arg_max(value, event_id) FILTER (WHERE event_type = '{e}'), 6) AS {e if e != 'view' else 'view'}" for e in ("view", "click", "purchase"))
O["long_to_wide"] = f"WITH {RAW} SELECT equipment_id, {ts(HR.format('timestamp_utc'), 'timestamp_utc')}, {_pv} FROM raw GROUP BY equipment_id, {HR.format('timestamp_utc')}"
BATCHES = (f"{RAW}, dd AS (SELECT equipment_id, date_trunc('day', timestamp_utc) AS d, value, event_id, event_type FROM raw), "
           "ex AS (SELECT * FROM dd WHERE event_type NOT IN ('purchase', 'error')), inc AS (SELECT equipment_id, d, value * 2 AS value, event_id, event_type FROM dd WHERE event_type IN ('purchase', 'error'))")
O["append_merge"] = (
    f"WITH {BATCHES}, u AS (SELECT *, 0 AS b FROM ex UNION ALL SELECT *, 1 AS b FROM inc), "
    "k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY equipment_id, d ORDER BY b DESC, event_id DESC) AS rn FROM u) "
    f"SELECT equipment_id, {ts('d', 'timestamp_utc')}, ROUND(value, 6) AS value, event_id FROM k WHERE rn = 1")
O["append_report"] = (
    f"WITH {BATCHES}, i AS (SELECT equipment_id, d, COUNT(*) AS n FROM inc GROUP BY 1, 2), e AS (SELECT DISTINCT equipment_id, d FROM ex) "
    "SELECT SUM(n)::BIGINT AS rows_in, COUNT(*) FILTER (WHERE e.d IS NULL) AS rows_new, COUNT(e.d) AS rows_overwritten FROM i LEFT JOIN e ON i.equipment_id = e.equipment_id AND i.d = e.d")
O["append_files"] = (f"WITH {BATCHES}, u AS (SELECT equipment_id, value, event_type FROM ex UNION ALL SELECT equipment_id, value, NULL FROM inc) "
                     "SELECT equipment_id, COUNT(*) AS n, COUNT(event_type) AS typed, ROUND(SUM(value), 4) AS total FROM u GROUP BY 1")
O["downsample_mean"] = (f"WITH {RAW}, w AS (SELECT equipment_id, time_bucket(INTERVAL 6 HOUR, timestamp_utc, TIMESTAMP '1970-01-01') AS b, value FROM raw) "
                        f"SELECT equipment_id, {ts('b', 'timestamp_utc')}, ROUND(AVG(value), 6) AS value FROM w GROUP BY equipment_id, b")
O["metric_to_imperial"] = (f"WITH {B} SELECT equipment_id, ROUND(AVG(oa_t * 9 / 5 + 32), 6) AS oa_t, ROUND(AVG(duct_static / 248.84::DOUBLE), 6) AS duct_static, "
                           "ROUND(AVG(zone_flow / 0.471947::DOUBLE), 6) AS zone_flow, ROUND(AVG(chw_dp), 6) AS chw_dp FROM history GROUP BY 1")
O["timestamp_profile"] = (
    f"WITH {RAW}, h AS (SELECT equipment_id, {HR.format('timestamp_utc')} AS t FROM raw), "
    "d AS (SELECT equipment_id, epoch(t) - epoch(LAG(t) OVER (PARTITION BY equipment_id ORDER BY t)) AS g FROM h), "
    "c AS (SELECT equipment_id, g, COUNT(*) AS n FROM d WHERE g > 0 GROUP BY 1, 2), m AS (SELECT equipment_id, g, ROW_NUMBER() OVER (PARTITION BY equipment_id ORDER BY n DESC, g) AS rn FROM c) "
    f"SELECT equipment_id, n_rows, duplicates, {ts('a', 'first_ts')}, {ts('z', 'last_ts')}, ROUND(g::DOUBLE, 6) AS interval_s FROM "
    "(SELECT equipment_id, COUNT(*) AS n_rows, COUNT(*) - COUNT(DISTINCT t) AS duplicates, MIN(t) AS a, MAX(t) AS z FROM h GROUP BY 1) s LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (equipment_id)")
O["scan_health"] = (
    "WITH h AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS equipment_id, o_orderdate AS t, o_orderkey AS o FROM orders), "
    "b AS (SELECT *, CASE WHEN t < LAG(t) OVER (PARTITION BY equipment_id ORDER BY o) THEN 1 ELSE 0 END AS back FROM h), "
    "u AS (SELECT DISTINCT equipment_id, t FROM h), m AS (SELECT equipment_id, epoch(t) - epoch(LAG(t) OVER (PARTITION BY equipment_id ORDER BY t)) AS g FROM u), "
    "md AS (SELECT equipment_id, quantile_cont(g, 0.5) AS x FROM m GROUP BY 1) "
    f"SELECT CAST(CAST(equipment_id AS INT) % 2 AS VARCHAR) AS building_id, CAST(CAST(b.equipment_id AS INT) // 2 AS VARCHAR) AS equipment_id, COUNT(*) AS samples, COUNT(*) - COUNT(DISTINCT t) AS duplicates, 0::BIGINT AS malformed, SUM(back)::BIGINT AS non_monotonic, "
    f"ROUND(ANY_VALUE(x)::DOUBLE, 6) AS median_delta_s, {ts('MIN(t)', 'first_ts')}, {ts('MAX(t)', 'last_ts')} FROM b JOIN md USING (equipment_id) GROUP BY b.equipment_id")
O["localize_dst"] = (
    "WITH o AS (SELECT o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 240) AS wall FROM orders), "
    "u AS (SELECT wall, (wall AT TIME ZONE 'America/Chicago') AS g FROM o), "
    "c AS (SELECT wall, UNNEST([g - INTERVAL 1 HOUR, g, g + INTERVAL 1 HOUR]) AS x, wall AS w2 FROM u), "
    "k AS (SELECT rid, wall, COUNT(*) FILTER (WHERE (x AT TIME ZONE 'America/Chicago') = wall) AS n, MIN(x) FILTER (WHERE (x AT TIME ZONE 'America/Chicago') = wall) AS utc "
    "FROM (SELECT ROW_NUMBER() OVER () AS rid, wall, g FROM u) q, UNNEST([g - INTERVAL 1 HOUR, g, g + INTERVAL 1 HOUR]) AS t(x) GROUP BY 1, 2) "
    "SELECT CASE WHEN n = 0 THEN 'gap' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS ts_status, COUNT(*) AS n, "
    "SUM(epoch(utc)::BIGINT - epoch(wall)::BIGINT)::BIGINT AS shift_s FROM k GROUP BY 1").replace(
    "c AS (SELECT wall, UNNEST([g - INTERVAL 1 HOUR, g, g + INTERVAL 1 HOUR]) AS x, wall AS w2 FROM u), ", "")
O["column_profile"] = (
    f"WITH {B}, v AS (SELECT 'occ_mode' AS \"column\", TRIM(occ_mode) AS v FROM history UNION ALL SELECT 'equipment_id', TRIM(equipment_id) FROM history) "
    "SELECT \"column\", 'text' AS kind, COUNT(*) AS rows, COUNT(*) FILTER (WHERE v IS NULL OR v = '') AS blank, COUNT(*) FILTER (WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL AND v <> '') AS numeric, "
    "MIN(v) AS example FROM v GROUP BY 1")
O["csv_quarantine"] = (
    "SELECT 'U' || (user_id % 8)::VARCHAR AS unit, CASE WHEN event_type = 'signup' THEN 'open_quote' WHEN event_id % 10 = 0 THEN 'blank_stamp' "
    "WHEN event_type = 'error' THEN 'bad_stamp' ELSE 'ok' END AS parse_status, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, COUNT(event_type) AS modes, "
    "TRUE AS numbered FROM events GROUP BY 1, 2")
O["analyze_quality"] = (
    f"WITH {RAW}, h AS (SELECT {HR.format('timestamp_utc')} AS t, CASE WHEN event_type = 'view' THEN event_type END AS note FROM raw) "
    "SELECT 'duplicate_timestamp' AS issue, 'timestamp_utc' AS \"column\", COUNT(*) - COUNT(DISTINCT t) AS n FROM h UNION ALL "
    "SELECT 'mostly_empty', 'note', COUNT(*) - COUNT(note) FROM h UNION ALL SELECT 'ambiguous_local_time', 'timestamp_utc', COUNT(*) FROM h WHERE hour(t) = 1")
O["ingest_quality_gate"] = (
    f"WITH {RAW}, h AS (SELECT equipment_id, CASE WHEN event_type <> 'error' THEN {HR.format('timestamp_utc')} END AS t, CASE WHEN event_type <> 'signup' THEN value END AS v FROM raw), "
    "c AS (SELECT 'bad_timestamp' AS k, COUNT(*) FILTER (WHERE t IS NULL) AS n, 1 AS hard FROM h UNION ALL SELECT 'empty_value', COUNT(*) FILTER (WHERE v IS NULL), 0 FROM h UNION ALL "
    "SELECT 'not_finite', 0, 1 UNION ALL SELECT 'no_identity', 0, 1 UNION ALL SELECT 'duplicate_timestamp', (SELECT SUM(x - 1) FROM (SELECT COUNT(*) AS x FROM h WHERE t IS NOT NULL GROUP BY equipment_id, t))::BIGINT, 1) "
    "SELECT k AS \"check\", n::BIGINT AS n, CASE WHEN n > 0 AND hard = 1 THEN 1 ELSE 0 END AS blocks FROM c")
O["audit_package"] = (
    f"WITH {B}, e AS (SELECT DISTINCT equipment_id FROM history), v AS (SELECT equipment_id FROM e WHERE equipment_id LIKE 'VAV%'), a AS (SELECT equipment_id FROM e WHERE equipment_id LIKE 'AHU%'), "
    "f AS (SELECT v.equipment_id, MIN(a.equipment_id) AS p FROM v LEFT JOIN a ON contains(v.equipment_id, a.equipment_id) GROUP BY 1) "
    "SELECT (SELECT COUNT(*) FROM e) AS absent_roles, (SELECT COUNT(*) FROM history WHERE timestamp_utc < TIMESTAMP '2024-01-02') AS before_trusted, "
    "ROUND((SELECT 100.0::DOUBLE * COUNT(p) / COUNT(*) FROM f), 6) AS feed_coverage_pct, (SELECT COUNT(*) FROM f WHERE p IS NULL) AS vavs_without_ahu, 0::BIGINT AS stale_feeds, 'incomplete' AS grade")
O["validate_building"] = (
    f"WITH {B}, s AS (SELECT equipment_id, COUNT(*) AS rows, COUNT(fan_cmd) > 0 AS f, COUNT(sat) > 0 AS t FROM history GROUP BY 1) "
    "SELECT equipment_id, rows, CASE WHEN equipment_id = 'METER_1' THEN 0 ELSE f::INT + t::INT END AS role_count, "
    "CASE WHEN equipment_id <> 'METER_1' AND f THEN '' ELSE 'fan_cmd' END AS missing, CASE WHEN equipment_id = 'METER_1' THEN 'error: no role map' WHEN NOT f THEN 'warning: missing roles' ELSE 'ok' END AS verdict FROM s")
_ex = " UNION ALL ".join(f"SELECT equipment_id, timestamp_utc AS t, '{r}' AS role, {r} AS value FROM history WHERE {r} IS NOT NULL" for r in ("sat", "mat"))
O["export_history"] = (f"WITH {B}, l AS ({_ex}) SELECT equipment_id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, "
                       "strftime((t AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%dT%H:%M:%S') AS timestamp_local, role, ROUND(value, 6) AS value FROM l")
O["page_of_rows"] = f"WITH {RAW} SELECT building_id, equipment_id, event_id, ROUND(value, 6) AS value FROM raw ORDER BY event_id LIMIT 25 OFFSET 40"
O["sql_over_views"] = f"WITH {B} SELECT equipment_id, COUNT(*) AS n, ROUND(AVG(sat), 6) AS mean_sat FROM history WHERE sat > 80 GROUP BY 1"

# --- sensors ---------------------------------------------------------------------------------
def _state() -> str:
    st = ["fan_status", "fan_cmd", "pump_status", "chw_pump_status", "chiller_status", "compressor_status", "chw_pump_cmd"]
    has = ", ".join(f"COUNT({r}) OVER (PARTITION BY equipment_id) > 0 AS has_{r}" for r in st)
    plant = " OR ".join(f"COALESCE({r} > 0.5, FALSE)" for r in ("pump_status", "chw_pump_status", "chiller_status", "compressor_status"))
    ons = (f"(CASE WHEN has_fan_status THEN COALESCE(fan_status > 0.5, FALSE) WHEN has_fan_cmd THEN COALESCE({n('fan_cmd')} > 0.05, FALSE) ELSE FALSE END) OR {plant} "
           f"OR COALESCE({n('chw_pump_cmd')} > 0.05, FALSE)")
    mv = " OR ".join(f"COALESCE(ABS({n0(r)} - LAG({n0(r)}) OVER ({EQW})) > 0.05, FALSE)" for r in ("clg_valve_pct", "htg_valve_pct", "oa_damper_pct", "reheat_valve_pct"))
    win = f"OVER ({EQW} RANGE BETWEEN INTERVAL 20 MINUTE PRECEDING AND CURRENT ROW)"
    return (f"hh AS (SELECT *, {has} FROM history), o1 AS (SELECT *, {' OR '.join('has_' + r for r in st)} AS known, {ons} AS ison FROM hh), "
            f"o2 AS (SELECT *, CASE WHEN ison AND NOT COALESCE(LAG(ison) OVER ({EQW}), FALSE) THEN 1 ELSE 0 END AS sta, CASE WHEN NOT ison AND COALESCE(LAG(ison) OVER ({EQW}), FALSE) THEN 1 ELSE 0 END AS sto, "
            f"CASE WHEN {mv} THEN 1 ELSE 0 END AS mov FROM o1), o3 AS (SELECT *, MAX(sta) {win} AS rs, MAX(sto) {win} AS rp, MAX(mov) {win} AS rm FROM o2), "
            "st AS (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN_STATE' WHEN rp = 1 THEN 'SHUTDOWN_TRANSIENT' WHEN rs = 1 THEN 'STARTUP_TRANSIENT' WHEN NOT ison THEN 'OFF' "
            "WHEN rm = 1 THEN 'STARTUP_TRANSIENT' ELSE 'RUNNING_STEADY' END AS op_state FROM o3)")


O["operating_state"] = f"WITH {B}, {_state()} SELECT equipment_id, op_state, COUNT(*) AS n FROM st GROUP BY 1, 2"


def _rates(src: str) -> str:
    """From `src`(equipment_id, role, t, value, ...) with epoch seconds `e`."""
    w = "PARTITION BY equipment_id, role ORDER BY t"
    near = ""
    for m, tol in ((5, 2), (15, 7), (60, 30)):
        near += (f", n{m} AS (SELECT a.equipment_id, a.role, a.t, arg_min(COALESCE(b.value, 'nan'::DOUBLE), {{'d': ABS(b.e - (a.e - {m * 60})), 'o': -b.e}}) AS v FROM {src} a JOIN {src} b "
                 f"ON a.equipment_id = b.equipment_id AND a.role = b.role AND b.e BETWEEN a.e - {(m + tol) * 60} AND a.e - {(m - tol) * 60} GROUP BY 1, 2, 3)")
    r = lambda m: f"ABS(s.value - CASE WHEN isnan(n{m}.v) THEN NULL ELSE n{m}.v END) / ({m} / 60.0::DOUBLE) AS rate_{m}min"
    jn = " ".join(f"LEFT JOIN n{m} ON s.equipment_id = n{m}.equipment_id AND s.role = n{m}.role AND s.t = n{m}.t" for m in (5, 15, 60))
    return (f"i0 AS (SELECT *, CASE WHEN e - LAG(e) OVER ({w}) > 0 AND e - LAG(e) OVER ({w}) <= 7200 THEN (e - LAG(e) OVER ({w})) / 3600.0::DOUBLE END AS dth, ABS(value - LAG(value) OVER ({w})) AS dv FROM {src}), "
            "i1 AS (SELECT *, dv / dth AS inst FROM i0), "
            f"s AS (SELECT *, CASE WHEN COUNT(inst) OVER ({w} ROWS 2 PRECEDING) >= 3 THEN quantile_cont(inst, 0.5) OVER ({w} ROWS 2 PRECEDING) END AS robust FROM i1){near}, "
            f"rt AS (SELECT s.*, {r(5)}, {r(15)}, {r(60)} FROM s {jn})")


def _long(roles, src="history", extra="") -> str:
    return " UNION ALL ".join(f"SELECT equipment_id, '{r}' AS role, timestamp_utc AS t, epoch(timestamp_utc) AS e, {r}{f} AS value{extra} FROM {src}"
                              for r, f in roles)


O["compute_rates"] = (f"WITH {B}, lg AS ({_long([('sat', ''), ('zone_t', '')])}), {_rates('lg')} SELECT equipment_id, role, ROUND(SUM(inst), 3) AS instantaneous_rate, ROUND(SUM(rate_5min), 3) AS rate_5min, "
                      "ROUND(SUM(rate_15min), 3) AS rate_15min, ROUND(SUM(rate_60min), 3) AS rate_60min, ROUND(SUM(robust), 3) AS robust_slope_15min FROM rt GROUP BY 1, 2")


def _evaluate() -> str:
    w = "PARTITION BY equipment_id, role ORDER BY t"
    pa = 249.08891
    lim = (f"CASE WHEN op_state IN ('STARTUP_TRANSIENT','SHUTDOWN_TRANSIENT') THEN CASE role WHEN 'zone_t' THEN 12 WHEN 'sat' THEN 50 ELSE {5 * pa}::DOUBLE END "
           f"ELSE CASE role WHEN 'zone_t' THEN 6 WHEN 'sat' THEN 16 ELSE {1.25 * pa}::DOUBLE END END")
    return (f"WITH {B}, {_state()}, lg AS ({_long([('zone_t', ''), ('sat', ''), ('duct_static', f' * {pa}::DOUBLE')], 'st', ', op_state')}), {_rates('lg')}, "
            f"ov AS (SELECT *, COALESCE(robust, rate_15min, inst) AS prim, CASE WHEN COALESCE(robust, rate_15min, inst) >= {lim} THEN 1 ELSE 0 END AS f, "
            "CASE WHEN role = 'zone_t' AND rate_5min * (5 / 60.0::DOUBLE) >= 15 THEN 1 ELSE 0 END AS ex, "
            f"COALESCE(LEAD(e) OVER ({w}) - e, 300) AS dt FROM rt), i AS ({islands('ov', 'f', 't', 'equipment_id, role')}), "
            "c AS (SELECT *, CASE WHEN (f = 1 AND SUM(dt) OVER (PARTITION BY equipment_id, role, sid ORDER BY t ROWS UNBOUNDED PRECEDING) >= 600) OR ex = 1 THEN 1 ELSE 0 END AS v FROM i), "
            "a AS (SELECT equipment_id, role, MAX(prim) AS mr, SUM(v) AS vc, SUM(CASE WHEN v = 1 THEN COALESCE(dth, 0) ELSE 0 END) * 60 AS vm, MIN(CASE WHEN v = 1 THEN t END) AS fv, "
            "MAX(CASE WHEN v = 1 THEN t END) AS lv, COUNT(value) AS sc, COUNT(value) / COUNT(*)::DOUBLE AS dc, SUM(f) >= 2 OR MAX(ex) = 1 AS keep FROM c GROUP BY 1, 2) "
            "SELECT equipment_id, role, ROUND(mr, 4) AS maximum_rate, CASE WHEN keep THEN vc ELSE 0 END::BIGINT AS violation_count, ROUND(CASE WHEN keep THEN vm ELSE 0 END, 4) AS violation_minutes, "
            f"sc AS sample_count, ROUND(dc, 4) AS data_coverage, {ts('CASE WHEN keep THEN fv END', 'first_violation')}, {ts('CASE WHEN keep THEN lv END', 'last_violation')} FROM a")


O["evaluate_points"] = _evaluate()


def _sweep() -> str:
    from oracle.rules_sql import ENERGIZED, HELD, SPIKE
    rng = {"oa_t": (-60, 130), "mat": (-20, 110), "zone_t": (40, 100), "rat": (40, 100), "sat": (30, 150), "chw_supply_t": (30, 80), "chw_return_t": (30, 90),
           "hw_supply_t": (40, 220), "hw_return_t": (40, 220), "oa_h": (0, 100), "duct_static": (-1, 8)}
    src = " UNION ALL ".join(f"SELECT equipment_id, '{r}' AS role, timestamp_utc AS t, {r} AS value, {ENERGIZED} AS live, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, {SPIKE[r]}::DOUBLE AS sp, "
                             f"{'TRUE' if r in HELD else 'FALSE'} AS held FROM history" for r, (lo, hi) in rng.items())
    w = "PARTITION BY equipment_id, role ORDER BY t"
    sp = lambda k: f"CASE WHEN COUNT(value) OVER ({w} ROWS {k - 1} PRECEDING) >= {k} THEN MAX(value) OVER ({w} ROWS {k - 1} PRECEDING) - MIN(value) OVER ({w} ROWS {k - 1} PRECEDING) END"
    return (f"WITH {B}, lg AS ({src}), q AS (SELECT *, ABS(value - LAG(value) OVER ({w})) AS st, {sp(12)} AS fl, {sp(24)} AS sl FROM lg), "
            "f AS (SELECT *, 'SV-RANGE' AS rule_id FROM q WHERE live AND (value < lo OR value > hi) UNION ALL SELECT *, 'SV-SPIKE' FROM q WHERE live AND st > sp "
            "UNION ALL SELECT *, 'SV-FLATLINE' FROM q WHERE live AND held AND fl <= 0.1 UNION ALL SELECT *, 'SV-STALE' FROM q WHERE held AND sl <= 0.05), "
            "ev AS (SELECT equipment_id, role, rule_id, COUNT(*) AS fault_samples, COUNT(*) * 300 / 3600.0::DOUBLE AS fh, MIN(value) AS mn, MAX(value) AS mx, AVG(value) AS av, MIN(t) AS a, MAX(t) AS z FROM f GROUP BY 1, 2, 3)")


O["sweep_evidence"] = (f"{_sweep()} SELECT equipment_id, role, rule_id, fault_samples, ROUND(fh, 6) AS fault_hours, ROUND(mn, 6) AS fault_min, ROUND(mx, 6) AS fault_max, ROUND(av, 6) AS fault_mean, "
                       f"{ts('a', 'first_fault')}, {ts('z', 'last_fault')} FROM ev")
_mx = ", ".join(f"ROUND(COALESCE(SUM(fh) FILTER (WHERE rule_id = '{r}'), 0), 6) AS {r.lower().replace('-', '_')}" for r in ("SV-RANGE", "SV-SPIKE", "SV-FLATLINE", "SV-STALE"))
O["sensor_fault_matrix"] = f"{_sweep()} SELECT equipment_id, role, {_mx}, ROUND(SUM(fh), 6) AS total_hours FROM ev GROUP BY 1, 2"


def _hunt() -> str:
    pc = lambda x: f"(CASE WHEN {x} > 1 THEN {x} ELSE {x} * 100 END)"
    src = " UNION ALL ".join(f"SELECT equipment_id, '{r}' AS role, timestamp_utc AS t, {pc(r)} AS o, {r} AS value, {fan()} AND COALESCE(loop_enabled, 1) > 0.05 AS live FROM history"
                             for r in ("oa_damper_pct", "clg_valve_pct", "htg_valve_pct", "damper_pct"))
    w = "PARTITION BY equipment_id, role ORDER BY t"
    f = f"OVER ({w} ROWS 11 PRECEDING)"
    return (f"WITH {B}, lg AS ({src}), a AS (SELECT *, o - LAG(o) OVER ({w}) AS mv FROM lg), b AS (SELECT *, CASE WHEN mv IS NULL THEN NULL WHEN ABS(mv) >= 1 THEN mv ELSE 0 END AS sd FROM a), "
            f"c AS (SELECT *, CASE WHEN sd * LAG(sd) OVER ({w}) < 0 THEN 1 ELSE 0 END AS tn FROM b), "
            f"q AS (SELECT *, COUNT(o) {f} AS cn, SUM(COALESCE(ABS(sd), 0)) {f} AS tv, MAX(o) {f} - MIN(o) {f} AS sp, SUM(tn) {f} AS tns FROM c), "
            "z AS (SELECT *, CASE WHEN live AND o IS NOT NULL AND cn >= 10 AND sp >= 20 AND tv >= 500 AND tv / (2 * NULLIF(sp, 0)) >= 2.5 AND tns >= 4 THEN 1 ELSE 0 END AS bad FROM q) "
            "SELECT equipment_id, role, COUNT(value) AS samples, SUM(bad)::BIGINT AS hunting_samples, ROUND(SUM(bad) * 300 / 3600.0::DOUBLE, 4) AS hunting_hours, ROUND(MAX(tv), 4) AS max_total_variation, "
            "MAX(tns)::BIGINT AS max_reversals, ROUND(MAX(sp), 4) AS max_span FROM z GROUP BY 1, 2")


O["hunting_by_output"] = _hunt()

# --- topology --------------------------------------------------------------------------------
FEEDS = ("ev AS (SELECT DISTINCT equipment_id FROM history), fd AS (SELECT v.equipment_id, MIN(a.equipment_id) AS parent_ahu FROM ev v LEFT JOIN (SELECT * FROM ev WHERE equipment_id LIKE 'AHU%') a "
         "ON contains(v.equipment_id, a.equipment_id) WHERE v.equipment_id LIKE 'VAV%' GROUP BY 1)")
O["infer_parent"] = f"WITH {B}, {FEEDS} SELECT equipment_id, parent_ahu FROM fd"
O["attach_parent_sat"] = (f"WITH {B}, {FEEDS} SELECT h.equipment_id, ROUND(AVG(COALESCE(p.sat, h.ahu_sat)), 6) AS mean_parent_sat, COUNT(COALESCE(p.sat, h.ahu_sat)) AS n FROM history h JOIN fd USING (equipment_id) "
                          "LEFT JOIN history p ON p.equipment_id = fd.parent_ahu AND p.timestamp_utc = h.timestamp_utc GROUP BY 1")
SATIS = ("ls AS (SELECT timestamp_utc, MIN(CASE WHEN (equipment_id LIKE 'VAV%' OR equipment_id LIKE 'ZONE%') AND zone_t IS NOT NULL THEN (zone_t BETWEEN 60 AND 85)::INT END) AS zones_ok, "
         "MIN(CASE WHEN equipment_id LIKE 'AHU%' AND sat IS NOT NULL AND sat_sp IS NOT NULL THEN (ABS(sat - sat_sp) <= 40)::INT END) AS ahus_ok FROM history GROUP BY 1)")
O["load_satisfaction"] = f"WITH {B}, {SATIS} SELECT {ts('timestamp_utc')}, zones_ok, ahus_ok FROM ls"


def _noload() -> str:
    q = rule_sql()["CHW-NOLOAD-1"]
    head = (f"WITH {B}, {SATIS}, hx AS (SELECT h.* REPLACE (COALESCE(zones_ok, 0)::DOUBLE AS building_zone_load_satisfied, COALESCE(ahus_ok, 0)::DOUBLE AS building_ahu_load_satisfied) "
            "FROM history h LEFT JOIN ls USING (timestamp_utc) WHERE equipment_id LIKE 'CHILLER%')")
    return head + q[len(f"WITH {B}"):].replace("FROM history)", "FROM hx)")


O["chw_noload_from_topology"] = _noload()
O["invert_feeds"] = f"WITH {B}, {FEEDS} SELECT parent_ahu, STRING_AGG(equipment_id, ',' ORDER BY equipment_id) AS children, COUNT(*) AS child_count FROM fd WHERE parent_ahu IS NOT NULL GROUP BY 1"
PTS = ("pts AS (SELECT c_custkey AS point_id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'N' || c_nationkey END AS equip_ref, c_mktsegment AS seg, "
       "c_mktsegment IN ('AUTOMOBILE','BUILDING','MACHINERY','FURNITURE') AS mapped FROM customer)")
O["model_coverage"] = (f"WITH {PTS} SELECT COUNT(*) AS point_count, COUNT(*) FILTER (WHERE mapped) AS mapped_points, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE mapped) / COUNT(*), 1) AS model_score, "
                       "COUNT(*) FILTER (WHERE NOT mapped) AS unmapped_points, (SELECT COUNT(*) FROM nation) AS equipment_count FROM pts")
O["source_coverage"] = (f"WITH {PTS} SELECT CASE seg WHEN 'AUTOMOBILE' THEN 'csv' WHEN 'BUILDING' THEN 'bacnet' WHEN 'MACHINERY' THEN 'modbus' WHEN 'FURNITURE' THEN 'json_api' ELSE 'unmapped' END AS protocol, "
                        "COUNT(*) AS point_count FROM pts GROUP BY 1")
O["unmapped_points"] = f"WITH {PTS} SELECT point_id, name, equip_ref FROM pts WHERE NOT mapped"
O["points_by_equipment"] = f"WITH {PTS} SELECT COALESCE(equip_ref, 'unassigned') AS equip_ref, COUNT(*) AS point_count, COUNT(*) FILTER (WHERE mapped) AS mapped_count FROM pts GROUP BY 1"
O["equipment_summary"] = "SELECT r_name AS equip_type, COUNT(*) AS equipment_count FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
O["feeds_edges"] = ("SELECT 'N' || n.n_regionkey AS src, 'N' || n.n_nationkey AS dst, s.n_name AS src_label, n.n_name AS dst_label FROM nation n JOIN nation s ON s.n_nationkey = n.n_regionkey")
O["list_by_site"] = (f"WITH {PTS} SELECT r_name AS site_ref, COUNT(DISTINCT n_nationkey) AS equipment_count, COALESCE(SUM(pc), 0)::BIGINT AS point_count FROM nation JOIN region ON n_regionkey = r_regionkey "
                     "LEFT JOIN (SELECT equip_ref, COUNT(*) AS pc FROM pts GROUP BY 1) p ON p.equip_ref = 'N' || n_nationkey GROUP BY 1")


def _gap() -> str:
    vals = ", ".join(f"('{i}', '{k}', [{', '.join(repr(x) for x in r.required)}])" for i, r in RULES.items() if r.required for k in r.kinds)
    roles = ["sat", "mat", "rat", "oa_t", "fan_cmd", "zone_t", "damper_pct", "zone_flow", "chw_supply_t"]
    m = " UNION ".join(f"SELECT DISTINCT equipment_id, {KIND} AS kind, '{r}' AS role FROM history WHERE {r} IS NOT NULL" for r in roles)
    return (f"WITH {B}, m AS ({m}), hv AS (SELECT equipment_id, kind, list(role) AS hv FROM m GROUP BY 1, 2), ru(rule_id, kind, req) AS (VALUES {vals}), "
            "x AS (SELECT equipment_id, rule_id, list_sort(list_filter(req, lambda r: NOT list_contains(hv, r))) AS ms FROM hv JOIN ru USING (kind)) "
            "SELECT equipment_id, rule_id, array_to_string(ms, ',') AS missing, len(ms)::INT AS missing_count FROM x WHERE len(ms) > 0")


O["role_map_gap"] = _gap()
O["suggest_roles"] = ("SELECT CASE WHEN p_name LIKE '%ring%' THEN 'sat' WHEN p_name LIKE '%gear%' THEN 'fan_cmd' WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'zone_t' "
                      "WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'mat' END AS role, COUNT(*) AS n, MIN(p_partkey) AS first_key FROM part GROUP BY 1")
_PARTS = ("p AS (SELECT p_type, p_brand, CASE p_size % 3 WHEN 0 THEN 'DAT_Y ' WHEN 1 THEN 'dat_x ' ELSE '' END || p_name AS \"column\", "
          "CASE WHEN p_name LIKE '%ring%' THEN 'sat' WHEN p_name LIKE '%gear%' THEN 'fan_cmd' WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'zone_t' "
          "WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'mat' END AS role, p_size % 3 AS k FROM part)")
O["suggest_columns"] = (
    f"WITH {_PARTS}, s AS (SELECT *, CASE WHEN role = 'sat' AND k = 0 THEN 60 WHEN role = 'sat' AND k = 1 THEN 10 ELSE 0 END AS score FROM p WHERE role IS NOT NULL), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type, p_brand, role ORDER BY score DESC, \"column\") AS rn FROM s) "
    "SELECT p_type, p_brand, role, \"column\", score FROM r WHERE rn = 1")
O["suggest_unmapped"] = f"WITH {_PARTS} SELECT DISTINCT p_type, p_brand, \"column\" FROM p WHERE role IS NULL"
O["resolve_roles"] = ("SELECT CASE p_partkey % 7 WHEN 0 THEN 'sat' WHEN 1 THEN 'fan_cmd' WHEN 2 THEN 'oa_t' WHEN 3 THEN 'zone_t' WHEN 4 THEN 'chw_supply_t' WHEN 5 THEN 'steam_flow' ELSE 'sat' END AS role, "
                      "COUNT(*) AS n FROM part GROUP BY 1")
O["pick_best_column"] = (
    "WITH c AS (SELECT DISTINCT 'B' || (p_partkey % 2 + 1) AS building_id, p_brand AS equipment_id, 'sat' AS role, CASE p_size % 4 WHEN 0 THEN 'dat_x_1_' || p_size WHEN 1 THEN 'discharge_air_temp_f' WHEN 2 THEN 'dat_y_' || p_size ELSE 'DAT_2_' || p_size END AS \"column\", "
    "CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 60 ELSE 5 END AS score FROM part), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, equipment_id, role ORDER BY score DESC, \"column\") AS rn FROM c) "
    "SELECT building_id, equipment_id, role, \"column\", score FROM r WHERE rn = 1")
