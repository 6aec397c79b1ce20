"""ANSI SQL for the rule queries: each predicate is written out a second time and confirmed
by classic gaps-and-islands, so it checks both the predicate and the streak logic."""

from __future__ import annotations

from thermaline.sources.driver_tables import WEATHER_WHERE, history_sql

POLL = 300


def base_ctes() -> str:
    return f"history AS ({history_sql()}), weather AS (SELECT * FROM history WHERE {WEATHER_WHERE})"


def n(x):
    return f"(CASE WHEN {x} > 1 THEN {x} / CAST(100 AS DOUBLE) ELSE {x} END)"


def n0(x):
    return f"COALESCE({n(x)}, 0)"


def n15(x):
    return f"(CASE WHEN {x} >= 1.5 THEN {x} / CAST(100 AS DOUBLE) ELSE {x} END)"


def fan(default="TRUE", command="0.01"):
    return (f"(CASE WHEN fan_status IS NOT NULL THEN fan_status > 0.05 "
            f"WHEN fan_cmd IS NOT NULL THEN {n('fan_cmd')} > {command} ELSE {default} END)")


ENERGIZED = (f"(CASE WHEN fan_status IS NOT NULL THEN fan_status > 0.05 WHEN fan_cmd IS NOT NULL THEN {n('fan_cmd')} > 0.01 "
             f"WHEN pump_status IS NOT NULL THEN pump_status > 0.05 "
             f"WHEN chw_pump_cmd IS NOT NULL THEN {n('chw_pump_cmd')} > 0.05 "
             f"WHEN chiller_status IS NOT NULL THEN chiller_status > 0.05 ELSE TRUE END)")


def hydro(flow=True):
    f = "WHEN chw_flow IS NOT NULL THEN chw_flow > 1 " if flow else ""
    return (f"(CASE WHEN pump_status IS NOT NULL THEN pump_status > 0.05 "
            f"WHEN chiller_status IS NOT NULL THEN chiller_status > 0.05 {f}"
            f"WHEN chw_pump_cmd IS NOT NULL THEN {n('chw_pump_cmd')} > 0.05 ELSE FALSE END)")


CHILLER = (f"(CASE WHEN pump_status IS NOT NULL THEN pump_status > 0.05 WHEN chiller_status IS NOT NULL THEN chiller_status > 0.05 "
           f"WHEN chiller_current IS NOT NULL THEN chiller_current > 0.5 WHEN chiller_amps IS NOT NULL THEN chiller_amps > 0.5 "
           f"WHEN chiller_power IS NOT NULL THEN chiller_power > 0.5 WHEN chw_flow IS NOT NULL THEN chw_flow > 1 "
           f"WHEN chw_pump_cmd IS NOT NULL THEN {n('chw_pump_cmd')} > 0.05 ELSE FALSE END)")
TOK = "LOWER(TRIM(occ_mode))"
UN = "('unoccupied','unocc','off','false','night','standby','setback','no')"
UNZ = "('unoccupied','unocc','off','false','night','standby','setback','no','0','0.0')"
OAF = "((mat - rat) / NULLIF(oa_t - rat, 0))"
FLOW = "COALESCE(zone_flow, 0) > 25"
WT, WD = "COALESCE(web_oa_t, wx_web_oa_t)", "COALESCE(web_oa_dp, wx_web_oa_dp)"

# rule: (confirm rows at 300 s, predicate)
PREDICATES = {
    "VAV-2": (3, f"{TOK} IN {UNZ} AND zone_t > 68"),
    "FC13-SAT-HIGH": (2, f"{fan()} AND {n0('clg_valve_pct')} > 0.01 AND sat > sat_sp + 1 AND "
                         f"({n0('oa_damper_pct')} <= 0.05 OR {n0('oa_damper_pct')} > 0.9)"),
    "ECON-2": (1, f"oa_t > 63 AND {n15('oa_damper_pct')} > 0.42"),
    "FC1": (1, f"{fan()} AND duct_static < duct_static_sp - CAST(0.12 AS DOUBLE) AND {n('fan_cmd')} >= CAST(1 AS DOUBLE) - CAST(0.13 AS DOUBLE)"),
    "FC2": (2, f"{fan()} AND rat IS NOT NULL AND oa_t IS NOT NULL AND mat + CAST(1.15 AS DOUBLE) < CASE WHEN rat < oa_t THEN rat ELSE oa_t END - CAST(1.15 AS DOUBLE)"),
    "FC3": (2, f"{fan()} AND {n0('fan_cmd')} > 0.01 AND mat - CAST(1.15 AS DOUBLE) > rat + CAST(1.15 AS DOUBLE) AND mat - CAST(1.15 AS DOUBLE) > oa_t + CAST(1.15 AS DOUBLE)"),
    "FC7": (2, f"COALESCE(CASE WHEN fan_status IS NOT NULL THEN CASE WHEN fan_status > 0.05 THEN 1 ELSE 0 END ELSE {n('fan_cmd')} END, 0) > 0.01 "
               f"AND sat < sat_sp - 1 AND {n0('htg_valve_pct')} >= 0.9"),
    "FC8": (2, f"{fan()} AND {n0('oa_damper_pct')} > 0.05 AND {n0('clg_valve_pct')} < 0.1 AND ABS(sat - CAST(0.55 AS DOUBLE) - mat) > 1.626345153"),
    "FC9": (2, f"{fan()} AND {n0('oa_damper_pct')} > 0.05 AND {n0('clg_valve_pct')} < 0.1 AND oa_t - CAST(1.15 AS DOUBLE) > sat_sp - CAST(0.55 AS DOUBLE) + CAST(1.15 AS DOUBLE)"),
    "FC10": (2, f"{fan()} AND {n0('clg_valve_pct')} > 0.01 AND {n0('oa_damper_pct')} > 0.9 AND ABS(mat - oa_t) > 1.626345153"),
    "FC11": (2, f"{fan()} AND {n0('clg_valve_pct')} > 0.01 AND {n0('oa_damper_pct')} > 0.9 AND oa_t + CAST(1.15 AS DOUBLE) < sat_sp - CAST(0.55 AS DOUBLE) - CAST(1.15 AS DOUBLE)"),
    "FC12": (2, f"{fan()} AND {n0('clg_valve_pct')} > 0.01 AND sat - CAST(1.15 AS DOUBLE) - CAST(0.55 AS DOUBLE) > mat + CAST(1.15 AS DOUBLE) AND "
                f"({n0('oa_damper_pct')} <= 0.05 OR {n0('oa_damper_pct')} > 0.9)"),
    "ECON-1": (2, f"(CASE WHEN fan_cmd IS NOT NULL THEN {n15('fan_cmd')} > 0.01 WHEN fan_status IS NOT NULL THEN fan_status > 0.5 ELSE FALSE END) "
                  f"AND {n15('oa_damper_pct')} < 0.05 AND oa_t > 55"),
    "ECON-4": (2, f"{fan()} AND {n0('fan_cmd')} > 0.01 AND ABS(rat - oa_t) > 2.2 AND {OAF} * 100 < 21"),
    "SV-RANGE": (1, f"{ENERGIZED} AND (COALESCE(oa_t NOT BETWEEN -60 AND 130, FALSE) OR COALESCE(mat NOT BETWEEN -20 AND 110, FALSE) "
                    "OR COALESCE(zone_t NOT BETWEEN 40 AND 100, FALSE) OR COALESCE(rat NOT BETWEEN 40 AND 100, FALSE) "
                    "OR COALESCE(sat NOT BETWEEN 30 AND 150, FALSE) OR COALESCE(chw_supply_t NOT BETWEEN 30 AND 80, FALSE) "
                    "OR COALESCE(chw_return_t NOT BETWEEN 30 AND 90, FALSE) OR COALESCE(hw_supply_t NOT BETWEEN 40 AND 220, FALSE) "
                    "OR COALESCE(hw_return_t NOT BETWEEN 40 AND 220, FALSE) OR COALESCE(oa_h NOT BETWEEN 0 AND 100, FALSE) "
                    "OR COALESCE(duct_static NOT BETWEEN -1 AND 8, FALSE))"),
    "FC5": (2, f"{fan()} AND {n('fan_cmd')} >= 0.05 AND {n('htg_valve_pct')} > 0.01 AND sat + CAST(1.15 AS DOUBLE) <= mat - CAST(1.15 AS DOUBLE) + CAST(0.55 AS DOUBLE)"),
    "FC6": (2, f"{fan()} AND vav_total_flow > 0 AND {n('fan_cmd')} >= 0.05 AND ABS(rat - oa_t) >= 5 AND ABS({OAF} - CAST(5000 AS DOUBLE) / vav_total_flow) > 0.15"),
    "FC14": (2, f"{fan()} AND {n0('fan_cmd')} >= 0.05 AND {n0('clg_valve_pct')} <= 0.01 AND "
                "ABS(COALESCE(cooling_coil_entering_temp, mat) - COALESCE(cooling_coil_leaving_temp, sat)) >= SQRT(CAST(2 AS DOUBLE) * CAST(1.15 AS DOUBLE) * CAST(1.15 AS DOUBLE)) + CAST(0.55 AS DOUBLE)"),
    "FC15": (2, f"{fan()} AND {n0('fan_cmd')} >= 0.05 AND {n0('htg_valve_pct')} <= 0.01 AND {n0('clg_valve_pct')} <= 0.01 AND "
                "ABS(COALESCE(heating_coil_entering_temp, mat) - COALESCE(heating_coil_leaving_temp, sat)) >= SQRT(CAST(2 AS DOUBLE) * CAST(1.15 AS DOUBLE) * CAST(1.15 AS DOUBLE)) + CAST(0.55 AS DOUBLE)"),
    "AHU-SATDEV": (2, f"{fan('FALSE')} AND ABS(sat - sat_sp) > 5"),
    "AHU-DUCTHI": (1, f"CASE WHEN {fan('NULL')} IS NULL THEN ABS(duct_static) > 0.2 ELSE {fan('NULL')} END AND duct_static > duct_static_sp + CAST(0.25 AS DOUBLE)"),
    "AHU-SIMUL": (1, f"{fan()} AND {n('htg_valve_pct')} > 0.1 AND {n('clg_valve_pct')} > 0.1"),
    "ECON-3": (1, f"{fan()} AND {WT} >= 60 AND {WT} < 72 AND {WD} < 60 AND {n('clg_valve_pct')} > 0.01 AND {n('oa_damper_pct')} < 0.9"),
    "ECON-5": (2, f"{fan()} AND {n0('htg_valve_pct')} > 0.01 AND ((oa_t > sat_sp AND preheat_leave_t - oa_t > 2.2) OR (oa_t < sat_sp AND preheat_leave_t - sat_sp > 2.2))"),
    "ECON-6": (2, f"{fan()} AND {WT} < 25 AND {n('oa_damper_pct')} > 0.25"),
    "ECON-7": (2, f"{fan()} AND {WT} >= 35 AND {WT} < 72 AND {WD} < 60 AND {n('clg_valve_pct')} > 0.05 AND {n('oa_damper_pct')} < 0.5"),
    "MECH-OAT-1": (2, f"web_oa_t < 60 AND (COALESCE(chiller_status > 0.05, FALSE) OR COALESCE({n('clg_valve_pct')} > 0.05, FALSE))"),
    "CMD-1": (2, f"({n('fan_cmd')} >= 0.05) <> (fan_status > 0.5)"),
    "OA-1": (3, f"{fan()} AND ABS(rat - oa_t) > 2.2 AND {OAF} < 0.15 AND {n('fan_cmd')} >= 0.05"),
    "DMP-1": (3, f"{fan()} AND {n('oa_damper_pct')} <= 0.05 AND ABS(mat - oa_t) < 2"),
    "VLV-1": (3, f"{fan()} AND {n('clg_valve_pct')} <= 0.05 AND (COALESCE(sat < sat_sp - 2, FALSE) OR COALESCE(sat < mat - 2, FALSE))"),
    "VAV-3": (1, f"{fan()} AND {FLOW} AND oa_t > 78 AND {n('reheat_valve_pct')} > 0.52"),
    "VAV-5": (3, f"{fan()} AND zone_flow > 50 AND {n('damper_pct')} < 0.1"),
    "VAV-6": (3, f"COALESCE(clg_available, 1) > 0.05 AND oa_t < 65 AND {n('reheat_valve_pct')} > 0.25"),
    "VAV-REHEAT": (3, f"{fan()} AND {FLOW} AND {n('reheat_valve_pct')} > 0.3 AND vav_discharge_t - vav_inlet_t < 3"),
    "VAV-AHU-LEAVE": (3, f"{fan()} AND {FLOW} AND ABS(vav_discharge_t - ahu_sat) > 8"),
    "RESET-1": (3, f"{fan(command='0.05')} AND ABS(sat_sp - (CAST(52 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (oa_t - 65))) > 3"),
    "CHW-1": (3, f"{CHILLER} AND chw_return_t - chw_supply_t < 4"),
    "CHW-2": (1, f"{hydro()} AND {n('chw_pump_cmd')} >= 0.87 AND chw_dp < chw_dp_sp - CAST(2.2 AS DOUBLE)"),
    "CHW-3": (1, f"{hydro()} AND ABS(chw_supply_t - chw_supply_sp) > 2.2"),
    "CHW-4": (1, f"{hydro(False)} AND {n('chw_pump_cmd')} >= 0.87 AND chw_flow > 1100"),
    "CW-OPT-1": (3, f"{hydro()} AND cw_supply_t < web_wb_t + 7 - 2"),
    "CW-APR-1": (3, f"{hydro()} AND {n('tower_fan_cmd')} >= 0.95 AND cw_supply_t - web_wb_t > 8"),
    "CW-FAN-1": (3, f"{hydro()} AND {n('tower_fan_cmd')} >= 0.95 AND cw_supply_t > web_wb_t + 7 + 5"),
    "HP-1": (2, f"(CASE WHEN compressor_status IS NOT NULL THEN compressor_status > 0.05 WHEN fan_status IS NOT NULL THEN fan_status > 0.05 "
                f"WHEN fan_cmd IS NOT NULL THEN {n('fan_cmd')} > 0.05 ELSE TRUE END) AND {n('fan_cmd')} >= 0.05 AND zone_t < 69 AND sat < 85"),
    "TRIM-1": (6, f"COALESCE(duct_static, duct_static_sp) > 1.35 AND COALESCE(static_reset_request, 0) <= 1 AND {fan()}"),
    "TRIM-3": (6, f"{hydro()} AND hw_supply_t > 160 AND COALESCE(hw_reset_request_sum, 0) <= 1"),
    "TRIM-4": (6, f"{hydro()} AND chw_supply_t < 45 AND COALESCE(chw_reset_request_sum, 0) <= 1"),
    "SCHED-1": (6, f"fan_status > 0.5 AND ({TOK} IN {UN} OR COALESCE(TRY_CAST(TRIM(occ_mode) AS DOUBLE) <= 0.05, FALSE)) "
                   "AND (zone_t IS NULL OR zone_t BETWEEN 70 AND 75)"),
}
WEATHER_RULES = {"ECON-3", "ECON-6", "ECON-7", "OAT-METEO"}
EQW = "PARTITION BY equipment_id ORDER BY timestamp_utc"
WX = ("wx AS (SELECT timestamp_utc, MAX(oa_t) AS wx_oa_t, MAX(web_oa_t) AS wx_web_oa_t, MAX(web_oa_dp) AS wx_web_oa_dp "
      "FROM weather GROUP BY timestamp_utc), hist AS (SELECT h.*, wx.wx_oa_t, wx.wx_web_oa_t, wx.wx_web_oa_dp "
      "FROM history h LEFT JOIN wx ON h.timestamp_utc = wx.timestamp_utc)")


def tail(rows: int, final: str | None = None) -> str:
    final = final or (f"SELECT equipment_id, ROUND(SUM(done) * {POLL} / CAST(3600 AS DOUBLE), 6) AS fault_hours "
                      "FROM final GROUP BY equipment_id")
    return (f", lagged AS (SELECT *, CASE WHEN raw = LAG(raw) OVER ({EQW}) THEN 0 ELSE 1 END AS fresh FROM base), "
            f"grp AS (SELECT *, SUM(fresh) OVER ({EQW} ROWS UNBOUNDED PRECEDING) AS streak FROM lagged), "
            "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY equipment_id, streak ORDER BY timestamp_utc) AS len FROM grp), "
            f"final AS (SELECT *, CASE WHEN raw = 1 AND len >= {rows} THEN 1 ELSE 0 END AS done FROM ranked) {final}")


def raw_of(pred: str) -> str:
    return f"CASE WHEN {pred} THEN 1 ELSE 0 END"


def plain(rule_id: str) -> str:
    rows, pred = PREDICATES[rule_id]
    src, extra = ("hist", ", " + WX) if rule_id in WEATHER_RULES else ("history", "")
    return (f"WITH {base_ctes()}{extra}, base AS (SELECT equipment_id, timestamp_utc, {raw_of(pred)} AS raw FROM {src})"
            + tail(rows))


PCT = (f"SELECT equipment_id, ROUND(SUM(done) * {POLL} / CAST(3600 AS DOUBLE), 6) AS fault_hours, "
       "ROUND(CAST(100 AS DOUBLE) * SUM(done) / COUNT(*), 6) AS fault_pct FROM final GROUP BY equipment_id")
HELD = ["oa_t", "mat", "zone_t", "rat", "sat", "chw_supply_t", "chw_return_t", "hw_supply_t", "hw_return_t", "oa_h"]
SPIKE = {"oa_t": 36, "mat": 25, "zone_t": 12, "rat": 12, "sat": 40, "chw_supply_t": 20, "chw_return_t": 20,
         "hw_supply_t": 60, "hw_return_t": 60, "oa_h": 25, "duct_static": 2}


def _held(rows: int) -> str:
    f = f"OVER ({EQW} ROWS {rows - 1} PRECEDING)"
    return ", ".join(f"COUNT({r}) {f} AS n_{r}, MAX({r}) {f} - MIN({r}) {f} AS s_{r}" for r in HELD)


def special() -> dict[str, str]:
    b = base_ctes()
    out = {}
    out["FAN-RUNTIME-HOURS"] = (f"WITH {b} SELECT equipment_id, ROUND(SUM(CASE WHEN {n('fan_cmd')} > 0.05 THEN 1 ELSE 0 END) * 300 / CAST(3600 AS DOUBLE), 6) "
                                "AS fan_runtime_hours, ROUND(COUNT(*) * 300 / CAST(3600 AS DOUBLE), 6) AS total_hours FROM history WHERE fan_cmd IS NOT NULL GROUP BY equipment_id")
    out["AVG-ZONE-TEMP"] = (f"WITH {b} SELECT equipment_id, ROUND(AVG(zone_t), 6) AS avg_zone_temp, ROUND(MIN(zone_t), 6) AS min_zone_temp, "
                            "ROUND(MAX(zone_t), 6) AS max_zone_temp FROM history WHERE zone_t IS NOT NULL GROUP BY equipment_id")
    out["ZONE-COMFORT-PCT"] = (f"WITH {b} SELECT equipment_id, ROUND(CAST(100 AS DOUBLE) * SUM(CASE WHEN zone_t >= 68 AND zone_t <= 76 THEN 1 ELSE 0 END) / COUNT(*), 6) "
                               "AS comfort_pct FROM history WHERE zone_t IS NOT NULL GROUP BY equipment_id")
    out["FAULT-ELAPSED-HOURS"] = (f"WITH {b} SELECT equipment_id, SUM(CASE WHEN zone_t < 68 OR zone_t > 76 THEN 1 ELSE 0 END) AS fault_samples, "
                                  "ROUND(SUM(CASE WHEN zone_t < 68 OR zone_t > 76 THEN 1 ELSE 0 END) * 300 / CAST(3600 AS DOUBLE), 6) AS fault_hours "
                                  "FROM history WHERE zone_t IS NOT NULL GROUP BY equipment_id")
    out["VAV-1"] = (f"WITH {b}, base AS (SELECT equipment_id, timestamp_utc, {raw_of(f'(zone_t < 70 OR zone_t > 75) AND NOT COALESCE({TOK} IN {UNZ}, FALSE)')} AS raw "
                    "FROM history WHERE zone_t IS NOT NULL)" + tail(3, PCT))
    out["OAT-METEO"] = (f"WITH {b}, {WX}, base AS (SELECT equipment_id, timestamp_utc, {raw_of('ABS(oa_t - COALESCE(web_oa_t, wx_oa_t)) > 5')} AS raw "
                        "FROM hist WHERE equipment_id LIKE 'AHU%')" + tail(3, PCT))
    any_held = " OR ".join(f"COALESCE(n_{r} >= 12 AND s_{r} <= 0.1, FALSE)" for r in HELD)
    out["SV-FLATLINE"] = (f"WITH {b}, win AS (SELECT *, {_held(12)} FROM history), base AS (SELECT equipment_id, timestamp_utc, "
                          f"{raw_of(f'{ENERGIZED} AND ({any_held})')} AS raw FROM win)" + tail(1))
    mapped = " + ".join(f"CASE WHEN n_{r} >= 24 THEN 1 ELSE 0 END" for r in HELD)
    stale = " + ".join(f"CASE WHEN n_{r} >= 24 AND s_{r} <= 0.05 THEN 1 ELSE 0 END" for r in HELD)
    out["SV-STALE"] = (f"WITH {b}, win AS (SELECT *, {_held(24)} FROM history), sc AS (SELECT *, {mapped} AS m, {stale} AS st FROM win), "
                       f"base AS (SELECT equipment_id, timestamp_utc, {raw_of('m > 0 AND st = m')} AS raw FROM sc)" + tail(1))
    steps = ", ".join(f"ABS({r} - LAG({r}) OVER ({EQW})) AS d_{r}" for r in SPIKE)
    any_spike = " OR ".join(f"COALESCE(d_{r} > {v}, FALSE)" for r, v in SPIKE.items())
    out["SV-SPIKE"] = (f"WITH {b}, win AS (SELECT *, {steps} FROM history), base AS (SELECT equipment_id, timestamp_utc, "
                       f"{raw_of(f'{ENERGIZED} AND ({any_spike})')} AS raw FROM win)" + tail(1))
    rate = ["oa_t", "mat", "zone_t", "rat", "sat"]
    rs = ", ".join(f"ABS({r} - LAG({r}) OVER ({EQW})) AS d_{r}" for r in rate)
    over = " OR ".join(f"COALESCE(d_{r} / (dt / CAST(3600 AS DOUBLE)) > 6, FALSE)" for r in rate)
    out["SV-RATE"] = (f"WITH {b}, win AS (SELECT *, {rs}, epoch(timestamp_utc) - epoch(LAG(timestamp_utc) OVER ({EQW})) AS dt FROM history), "
                      f"fl AS (SELECT *, CASE WHEN dt > 0 AND dt <= 600 AND ({over}) THEN 1 ELSE 0 END AS o FROM win), "
                      f"base AS (SELECT equipment_id, timestamp_utc, CASE WHEN o = 1 AND COALESCE(LAG(o) OVER ({EQW}), 0) = 1 THEN 1 ELSE 0 END AS raw FROM fl)" + tail(2))

    def pc(x):
        return f"(CASE WHEN {x} > 1 THEN {x} ELSE {x} * 100 END)"
    outp = f"COALESCE({pc('oa_damper_pct')}, {pc('clg_valve_pct')}, {pc('htg_valve_pct')}, {pc('damper_pct')})"
    fr = f"OVER ({EQW} ROWS 11 PRECEDING)"
    out["PID-HUNT-1"] = (
        f"WITH {b}, o AS (SELECT *, {outp} AS o FROM history), d0 AS (SELECT *, o - LAG(o) OVER ({EQW}) AS mv FROM o), "
        "d1 AS (SELECT *, CASE WHEN mv IS NULL THEN NULL WHEN ABS(mv) >= 1 THEN mv ELSE 0 END AS sd FROM d0), "
        f"d2 AS (SELECT *, CASE WHEN sd * LAG(sd) OVER ({EQW}) < 0 THEN 1 ELSE 0 END AS turn FROM d1), "
        f"win AS (SELECT *, COUNT(o) {fr} AS cnt, SUM(COALESCE(ABS(sd), 0)) {fr} AS tv, MAX(o) {fr} - MIN(o) {fr} AS span, SUM(turn) {fr} AS turns FROM d2), "
        f"base AS (SELECT equipment_id, timestamp_utc, {raw_of(f'{fan()} AND COALESCE(loop_enabled, 1) > 0.05 AND o IS NOT NULL AND cnt >= 10 AND span >= 20 AND tv >= 500 AND tv / (2 * NULLIF(span, 0)) >= 2.5 AND turns >= 4')} AS raw FROM win)"
        + tail(1))
    speed = f"CASE WHEN fan_status IS NOT NULL THEN CASE WHEN fan_status > 0.05 THEN 1 ELSE 0 END ELSE {n('fan_cmd')} END"
    mode = (f"CASE WHEN COALESCE({speed}, 0) < 0.05 THEN 0 WHEN {n('clg_valve_pct')} > 0.1 THEN 3 "
            f"WHEN {n('oa_damper_pct')} > 0.5 THEN 2 ELSE 1 END")
    cnt = " OR ".join(f"SUM(CASE WHEN entry = 1 AND m = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY equipment_id, hr) > 5" for k in (1, 2, 3))
    out["FC4"] = (f"WITH {b}, md AS (SELECT *, date_trunc('hour', timestamp_utc) AS hr, {mode} AS m FROM history), "
                  f"en AS (SELECT *, CASE WHEN m <> 0 AND m <> LAG(m) OVER ({EQW}) THEN 1 ELSE 0 END AS entry FROM md), "
                  f"base AS (SELECT equipment_id, timestamp_utc, {raw_of(cnt)} AS raw FROM en)" + tail(12))
    cond = raw_of(f"{fan()} AND {FLOW} AND {n('damper_pct')} > 0.975")
    out["VAV-4"] = (f"WITH {b}, c AS (SELECT equipment_id, timestamp_utc, {cond} AS c FROM history), "
                    f"l1 AS (SELECT *, CASE WHEN c = LAG(c) OVER ({EQW}) THEN 0 ELSE 1 END AS f1 FROM c), "
                    f"g1 AS (SELECT *, SUM(f1) OVER ({EQW} ROWS UNBOUNDED PRECEDING) AS s1 FROM l1), "
                    "base AS (SELECT equipment_id, timestamp_utc, CASE WHEN c = 1 AND ROW_NUMBER() OVER (PARTITION BY equipment_id, s1 ORDER BY timestamp_utc) >= 18 "
                    "THEN 1 ELSE 0 END AS raw FROM g1)" + tail(3))
    f7 = f"OVER ({EQW} ROWS 11 PRECEDING)"
    v7 = (f"{fan()} AND zone_flow IS NOT NULL AND (COALESCE(zone_flow > 25 AND zone_flow < min_flow_sp, FALSE) "
          "OR COALESCE(rn >= 6 AND sd < 15 AND mu > 200, FALSE) OR COALESCE(rn >= 6 AND sd < 15 AND min_flow_sp > 250, FALSE))")
    out["VAV-7"] = (f"WITH {b}, win AS (SELECT *, STDDEV_SAMP(zone_flow) {f7} AS sd, AVG(zone_flow) {f7} AS mu, COUNT(zone_flow) {f7} AS rn FROM history), "
                    f"base AS (SELECT equipment_id, timestamp_utc, {raw_of(v7)} AS raw FROM win)" + tail(3))
    out["WX-1"] = (f"WITH {b}, win AS (SELECT *, ABS(oa_t - LAG(oa_t) OVER ({EQW})) AS d FROM history), "
                   f"base AS (SELECT equipment_id, timestamp_utc, {raw_of('d > 16')} AS raw FROM win)" + tail(1))
    run = (f"(COALESCE(chiller_status, 0) > 0.05 OR COALESCE(chiller_cmd, 0) > 0.05 OR COALESCE(chw_pump_status, 0) > 0.05 OR COALESCE({n('chw_pump_cmd')}, 0) > 0.05)")
    out["CHW-NOLOAD-1"] = (f"WITH {b}, base AS (SELECT equipment_id, timestamp_utc, "
                           f"{raw_of(f'{run} AND COALESCE(building_zone_load_satisfied, building_ahu_load_satisfied) > 0.5')} AS raw, "
                           "CASE WHEN building_zone_load_satisfied IS NOT NULL OR building_ahu_load_satisfied IS NOT NULL THEN 1 ELSE 0 END AS seen FROM history)"
                           + tail(6, "SELECT equipment_id, ROUND(SUM(done) * 300 / CAST(3600 AS DOUBLE), 6) AS fault_hours, "
                                     "CASE WHEN MAX(seen) = 0 THEN 'SKIPPED_MISSING_ROLES' WHEN SUM(done) > 0 THEN 'FAULT' ELSE 'PASS' END AS status "
                                     "FROM final GROUP BY equipment_id"))
    bit = (f"CASE WHEN fan_status IS NOT NULL THEN CASE WHEN fan_status > 0.05 THEN 1 ELSE 0 END WHEN pump_status IS NOT NULL THEN CASE WHEN pump_status > 0.05 THEN 1 ELSE 0 END "
           f"WHEN chiller_status IS NOT NULL THEN CASE WHEN chiller_status > 0.05 THEN 1 ELSE 0 END WHEN fan_cmd IS NOT NULL THEN CASE WHEN {n('fan_cmd')} >= 0.05 THEN 1 ELSE 0 END ELSE 0 END")
    out["SCHED-247"] = (f"WITH {b}, pr AS (SELECT equipment_id, timestamp_utc, {bit} AS bit FROM history), "
                        "base AS (SELECT equipment_id, timestamp_utc, CASE WHEN AVG(CAST(bit AS DOUBLE)) OVER (PARTITION BY equipment_id) >= 0.95 AND bit = 1 THEN 1 ELSE 0 END AS raw FROM pr)"
                        + tail(12))
    return out


def rule_sql() -> dict[str, str]:
    return {**{i: plain(i) for i in PREDICATES}, **special()}


def all_rules_sql() -> str:
    """Every confirmable rule as rows: the union of the single-rule queries."""
    parts = []
    for i, q in rule_sql().items():
        if i in ("FAN-RUNTIME-HOURS", "AVG-ZONE-TEMP", "ZONE-COMFORT-PCT", "FAULT-ELAPSED-HOURS"):
            continue
        parts.append(f"SELECT equipment_id, '{i}' AS rule_id, CASE WHEN fault_hours > 0 THEN 'FAULT' ELSE 'PASS' END AS status, "
                     f"fault_hours FROM ({q})")
    return " UNION ALL ".join(parts)


def without_weather_sql() -> str:
    """The rules that read the weather table, where there is none and some air handlers have no readings of their own."""
    mine = lambda c: f"CASE WHEN starts_with(equipment_id, 'AHU_1') THEN NULL ELSE {c} END"
    bare = (f"hist AS (SELECT * REPLACE ({mine('web_oa_t')} AS web_oa_t, {mine('web_oa_dp')} AS web_oa_dp), CAST(NULL AS DOUBLE) AS wx_oa_t, "
            "CAST(NULL AS DOUBLE) AS wx_web_oa_t, CAST(NULL AS DOUBLE) AS wx_web_oa_dp FROM history)")
    parts = []
    for i in sorted(WEATHER_RULES):
        least = f"COUNT({mine('web_oa_t')})" if i in ("OAT-METEO", "ECON-6") else f"LEAST(COUNT({mine('web_oa_t')}), COUNT({mine('web_oa_dp')}))"
        parts.append(f"SELECT f.equipment_id, '{i}' AS rule_id, CASE WHEN n = 0 THEN 'SKIPPED_MISSING_ROLES' WHEN fault_hours > 0 THEN 'FAULT' ELSE 'PASS' END AS status, "
                     f"CASE WHEN n > 0 THEN fault_hours END AS fault_hours FROM ({rule_sql()[i].replace(WX, bare)}) f "
                     f"JOIN (WITH {base_ctes()} SELECT equipment_id, {least} AS n FROM history GROUP BY 1) c ON c.equipment_id = f.equipment_id")
    return " UNION ALL ".join(parts)
