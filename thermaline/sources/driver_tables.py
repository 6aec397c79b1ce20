"""Building-telemetry views over the driver's parquet tables.

Every view is a row-by-row projection of a whole table (`events`, `orders`, `part`, ...):
no sampling, no window, one pass. The same projection text serves Spark (`div`) and ANSI
SQL (`//`), because it defines the input of an operator, not the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EQUIPMENT = 24
STEP_SECONDS = 300
EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC

# role: (low, high, rows per level, multiplier, offset, "NULL when" predicate)
LEVELS = {
    "oa_t": (20.0, 100.0, 6, 37, 3, None),
    "mat": (35.0, 95.0, 5, 29, 11, None),
    "rat": (60.0, 85.0, 9, 13, 7, None),
    "sat": (48.0, 100.0, 7, 41, 5, None),
    "sat_sp": (52.0, 75.0, 16, 19, 2, None),
    "zone_t": (62.0, 84.0, 6, 23, 1, "event_type = 'error' AND eq % 2 = 0"),
    "oa_h": (5.0, 108.0, 11, 31, 9, None),
    "preheat_leave_t": (40.0, 90.0, 8, 17, 4, None),
    "cooling_coil_entering_temp": (50.0, 80.0, 10, 11, 6, "eq % 2 = 0"),
    "cooling_coil_leaving_temp": (48.0, 78.0, 12, 7, 8, "eq % 3 = 0"),
    "heating_coil_entering_temp": (50.0, 80.0, 9, 27, 10, "eq % 3 = 1"),
    "heating_coil_leaving_temp": (52.0, 95.0, 7, 33, 12, "eq % 2 = 1"),
    "duct_static": (0.0, 2.4, 6, 7, 13, None),
    "duct_static_sp": (0.6, 1.8, 20, 9, 14, None),
    "static_reset_request": (0.0, 4.0, 15, 21, 15, "event_type = 'signup'"),
    "htg_valve_pct": (0.0, 100.0, 14, 43, 16, None),
    "reheat_valve_pct": (0.0, 100.0, 13, 47, 17, None),
    "damper_pct": (0.0, 112.0, 26, 53, 18, None),
    "zone_flow": (0.0, 900.0, 9, 59, 19, None),
    "vav_total_flow": (0.0, 20000.0, 10, 61, 20, None),
    "min_flow_sp": (50.0, 400.0, 30, 67, 21, "eq % 4 = 2"),
    "vav_discharge_t": (50.0, 100.0, 8, 71, 22, None),
    "vav_inlet_t": (50.0, 70.0, 12, 73, 23, None),
    "ahu_sat": (50.0, 75.0, 10, 79, 24, None),
    "clg_available": (0.0, 1.0, 18, 5, 25, "eq % 5 = 1"),
    "chiller_power": (0.0, 400.0, 11, 83, 26, "event_type = 'view'"),
    "chiller_amps": (0.0, 120.0, 11, 89, 27, None),
    "chiller_current": (0.0, 90.0, 13, 3, 28, "eq % 2 = 0"),
    "chw_pump_cmd": (0.0, 100.0, 9, 97, 29, None),
    "chw_supply_t": (38.0, 60.0, 10, 15, 30, None),
    "chw_return_t": (44.0, 66.0, 12, 25, 31, None),
    "chw_supply_sp": (42.0, 48.0, 24, 35, 32, None),
    "chw_dp": (4.0, 20.0, 8, 45, 33, None),
    "chw_dp_sp": (10.0, 14.0, 24, 55, 34, None),
    "chw_flow": (0.0, 1600.0, 9, 65, 35, "eq % 4 = 0"),
    "cw_supply_t": (60.0, 95.0, 10, 75, 36, None),
    "tower_fan_cmd": (0.0, 100.0, 12, 85, 37, None),
    "hw_supply_t": (100.0, 215.0, 13, 95, 38, None),
    "hw_return_t": (90.0, 200.0, 14, 22, 39, None),
    "web_oa_t": (18.0, 98.0, 12, 37, 40, "eq % 3 = 0 OR event_type = 'click'"),
    "web_oa_dp": (10.0, 80.0, 12, 32, 41, "eq % 3 = 0"),
    "web_wb_t": (30.0, 78.0, 12, 42, 42, None),
    "hw_reset_request_sum": (0.0, 5.0, 20, 52, 43, None),
    "chw_reset_request_sum": (0.0, 5.0, 21, 62, 44, None),
    "zone_t_sp": (68.0, 76.0, 48, 72, 45, None),
}
# role: (rows per level, off once in n levels, offset, "NULL when" predicate)
BITS = {
    "loop_enabled": (24, 7, 1, "eq % 5 = 3"),
    "fan_status": (40, 6, 2, "eq % 4 = 3"),
    "chiller_status": (22, 4, 3, "eq % 3 = 2"),
    "chiller_cmd": (26, 5, 4, "eq % 2 = 1"),
    "compressor_status": (18, 4, 5, "eq % 2 = 0"),
    "pump_status": (30, 5, 6, "eq % 4 = 1"),
    "chw_pump_status": (16, 3, 7, "eq % 3 = 0"),
    "building_zone_load_satisfied": (14, 2, 8, "eq % 6 = 5"),
    "building_ahu_load_satisfied": (10, 3, 9, "eq % 6 = 4 OR eq % 6 = 5"),
}
HUNT = "(seq {div} 48) % 4 = 1"   # outputs swing on every sample
FROZEN = "(seq {div} 48) % 4 = 3"  # every level holds still

# Even and odd numbers are two buildings that use the same equipment ids.
KIND = """CASE WHEN eq < 6 THEN 'AHU_' || CAST(eq {d} 2 + 1 AS {s})
     WHEN eq < 14 THEN 'VAV_AHU_' || CAST((eq - 6) {d} 2 % 2 + 1 AS {s}) || '_' || CAST((eq - 6) {d} 2 + 1 AS {s})
     WHEN eq < 16 THEN 'ZONE_1' WHEN eq < 18 THEN 'CHILLER_1'
     WHEN eq < 19 THEN 'BOILER_1' WHEN eq < 20 THEN 'COOLING_TOWER_1' WHEN eq < 22 THEN 'HEATPUMP_1'
     WHEN eq < 23 THEN 'METER_1' ELSE 'WEATHER_1' END"""


def _level(div: str, spec) -> str:
    lo, hi, rows, mult, off, null = spec
    step = f"(CASE WHEN {FROZEN.format(div=div)} THEN seq {div} 48 ELSE seq {div} {rows} END)"
    v = (f"(CAST({lo} AS DOUBLE) + CAST({hi - lo} AS DOUBLE) * "
         f"CAST(({step} * {mult} + eq * 17 + {off}) % 101 AS DOUBLE) / CAST(100 AS DOUBLE))")
    return f"CASE WHEN {null} THEN NULL ELSE {v} END" if null else v


def _bit(div: str, spec) -> str:
    rows, n, off, null = spec
    v = f"CASE WHEN (seq {div} {rows} + eq + {off}) % {n} = 0 THEN 0 ELSE 1 END"
    return f"CASE WHEN {null} THEN CAST(NULL AS DOUBLE) ELSE CAST({v} AS DOUBLE) END"


def _columns(div: str, string: str) -> dict[str, str]:
    hunt, d = HUNT.format(div=div), "CAST({} AS DOUBLE)"
    cols = {r: _level(div, s) for r, s in LEVELS.items()}
    cols |= {r: _bit(div, s) for r, s in BITS.items()}
    swing = d.format("10 + (seq % 2) * 70")
    cols["oa_damper_pct"] = f"CASE WHEN {hunt} THEN {swing} ELSE {_level(div, (0.0, 103.0, 8, 49, 46, None))} END"
    cols["clg_valve_pct"] = f"CASE WHEN {hunt} THEN {d.format('0')} ELSE {_level(div, (0.0, 102.0, 10, 39, 47, None))} END"
    cols["fan_cmd"] = (f"CASE WHEN {hunt} THEN {d.format('80')} WHEN eq % 7 = 6 THEN CAST(NULL AS DOUBLE) "
                       f"ELSE {_level(div, (0.0, 100.0, 8, 17, 48, None))} END")
    cols["mat"] = f"CASE WHEN eq % 6 = 5 THEN {cols['oa_t']} + CAST(1 AS DOUBLE) ELSE {cols['mat']} END"
    cols["fan_status"] = f"CASE WHEN eq % 12 = 2 THEN CAST(1 AS DOUBLE) ELSE {cols['fan_status']} END"
    cols["elec_power"], cols["gas_flow"] = "value", "value / CAST(10 AS DOUBLE)"
    cols["occ_mode"] = (f"CASE WHEN event_type = 'signup' THEN NULL WHEN (seq {div} 24) % 3 = 1 THEN ' Unoccupied' "
                        f"WHEN (seq {div} 24) % 3 = 2 THEN '0' ELSE 'occupied' END")
    return {"building_id": f"CASE WHEN eq % 2 = 0 THEN 'B1' ELSE 'B2' END",
            "equipment_id": KIND.format(s=string, d=div), **cols}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 5-minute wide history, one row per event."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        f"event_id % {EQUIPMENT} AS eq", f"event_id div {EQUIPMENT} AS seq", "event_type", "value")
    return ev.selectExpr(f"timestamp_seconds({EPOCH} + seq * {STEP_SECONDS}) AS timestamp_utc",
                         *[f"{e} AS {n}" for n, e in _columns("div", "STRING").items()])


def history_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in _columns("//", "VARCHAR").items())
    return (f"SELECT CAST(to_timestamp({EPOCH} + seq * {STEP_SECONDS}) AT TIME ZONE 'UTC' AS TIMESTAMP) AS timestamp_utc, "
            f"{cols} FROM (SELECT event_id % {EQUIPMENT} AS eq, event_id // {EQUIPMENT} AS seq, "
            f"event_type, value FROM events)")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thermaline.sources.history import weather_view
    return weather_view(history(spark, sf_dir))


WEATHER_WHERE = ("(equipment_id ILIKE '%weather%' OR equipment_id ILIKE '%meteo%' "
                 "OR equipment_id ILIKE '%oat%')")


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular samples: one series per user, in two buildings with the same ids; event values as the sensor."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "concat('B', cast(user_id % 2 + 1 as string)) AS building_id", "concat('EQ_', cast(user_id div 2 as string)) AS equipment_id",
        "cast(ts as timestamp) AS timestamp_utc", "event_id", "value", "event_type",
        "event_type <> 'error' AS is_on")


RAW_HISTORY_SQL = ("SELECT 'B' || CAST(user_id % 2 + 1 AS VARCHAR) AS building_id, 'EQ_' || CAST(user_id // 2 AS VARCHAR) AS equipment_id, ts AS timestamp_utc, event_id, "
                   "value, event_type, event_type <> 'error' AS is_on FROM events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
