"""Role vocabulary of the wide history table, aliases and unit conversion."""

from __future__ import annotations

#: A series is one equipment of one building: ids repeat from building to building.
SITE, EQ, TS = "building_id", "equipment_id", "timestamp_utc"
ID = (SITE, EQ)

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The sensor roles a history table may carry.
AIR_ROLES = [
    "oa_t", "mat", "rat", "sat", "sat_sp", "zone_t", "oa_h", "preheat_leave_t",
    "cooling_coil_entering_temp", "cooling_coil_leaving_temp",
    "heating_coil_entering_temp", "heating_coil_leaving_temp",
    "duct_static", "duct_static_sp", "static_reset_request", "fan_cmd", "fan_status",
    "oa_damper_pct", "clg_valve_pct", "htg_valve_pct", "loop_enabled",
]
TERMINAL_ROLES = [
    "damper_pct", "reheat_valve_pct", "zone_flow", "vav_total_flow", "min_flow_sp",
    "vav_discharge_t", "vav_inlet_t", "ahu_sat", "clg_available",
]
PLANT_ROLES = [
    "chiller_status", "chiller_cmd", "chiller_power", "chiller_amps", "chiller_current",
    "compressor_status", "pump_status", "chw_pump_status", "chw_pump_cmd", "chw_supply_t",
    "chw_return_t", "chw_supply_sp", "chw_dp", "chw_dp_sp", "chw_flow", "cw_supply_t",
    "tower_fan_cmd", "hw_supply_t", "hw_return_t",
]
WEATHER_ROLES = ["web_oa_t", "web_oa_dp", "web_wb_t"]
CROSS_ROLES = ["building_zone_load_satisfied", "building_ahu_load_satisfied"]
EXTRA_ROLES = [
    "hw_reset_request_sum", "chw_reset_request_sum", "return_fan", "cw_return_t",
    "elec_power", "gas_flow", "zone_t_sp",
]
TEXT_ROLES = ["occ_mode"]

NUMERIC_ROLES = (
    AIR_ROLES + TERMINAL_ROLES + PLANT_ROLES + WEATHER_ROLES + CROSS_ROLES + EXTRA_ROLES
)
ALL_ROLES = NUMERIC_ROLES + TEXT_ROLES

# Text columns kept as strings on ingest.
STRING_COLUMNS = ["occ_mode", "occupancy", "schedule", "mode", "equip_mode"]

# Tokens meaning "unoccupied".
UNOCCUPIED_TOKENS = ["unoccupied", "unocc", "off", "false", "night", "standby", "setback", "no"]
UNOCCUPIED_TOKENS_ZONE = UNOCCUPIED_TOKENS + ["0", "0.0"]


def role_type(role: str) -> T.DataType:
    return T.StringType() if role in STRING_COLUMNS else T.DoubleType()


def history_schema(roles=None, *, partitioned: bool = True) -> T.StructType:
    """Explicit union-of-roles schema; roles missing from a file read back as NULL."""
    fields = [T.StructField("timestamp_utc", T.TimestampType())]
    fields += [T.StructField(r, role_type(r)) for r in (roles or ALL_ROLES)]
    if partitioned:
        fields += [T.StructField(k, T.StringType())
                   for k in ("building_id", "equipment_id", "year", "month")]
    else:
        fields.insert(0, T.StructField("equipment_id", T.StringType()))
    return T.StructType(fields)


def ensure_roles(df: DataFrame, roles) -> DataFrame:
    """Add each absent role as a typed NULL column."""
    missing = {r: F.lit(None).cast(role_type(r)) for r in roles if r not in df.columns}
    return df.withColumns(missing) if missing else df


# Role sets whose metric readings convert to imperial units.
TEMPERATURE_ROLES = [
    "oa_t", "mat", "rat", "sat", "sat_sp", "zone_t", "zone_t_sp", "preheat_leave_t",
    "cooling_coil_entering_temp", "cooling_coil_leaving_temp",
    "heating_coil_entering_temp", "heating_coil_leaving_temp",
    "vav_discharge_t", "vav_inlet_t", "ahu_sat", "chw_supply_t", "chw_return_t",
    "chw_supply_sp", "cw_supply_t", "cw_return_t", "hw_supply_t", "hw_return_t",
    "web_oa_t", "web_oa_dp", "web_wb_t",
]
PRESSURE_ROLES = ["duct_static", "duct_static_sp"]
FLOW_ROLES = ["zone_flow", "vav_total_flow", "min_flow_sp"]
PA_PER_INWC = 248.84
LPS_PER_CFM = 0.471947


def metric_to_imperial(df: DataFrame) -> DataFrame:
    """degC to degF, Pa to in w.c., L/s to cfm, by role."""
    conv: dict[str, Column] = {}
    for name in df.columns:
        c = F.col(name)
        if name in TEMPERATURE_ROLES:
            conv[name] = c * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)
        elif name in PRESSURE_ROLES:
            conv[name] = c / F.lit(PA_PER_INWC)
        elif name in FLOW_ROLES:
            conv[name] = c / F.lit(LPS_PER_CFM)
    return df.withColumns(conv) if conv else df
