"""SQL oracles by query name.

The texts are written for one building, as the rules are defined. A query over the telemetry is checked against their union over the
buildings, each scoped to its own rows, so that nothing an operator mixes between buildings can pass.
"""

from oracle.analytics_sql import O as ANALYTICS
from oracle.core_sql import O as CORE
from oracle.rules_sql import all_rules_sql, rule_sql, without_weather_sql
from thermaline.sources.driver_tables import RAW_HISTORY_SQL, history_sql

BUILDINGS = ("B1", "B2")
#: Results without a building column: rows of single events, or keys that name the building.
UNLABELLED = {"join_exact_hour", "join_asof_previous", "join_floor_hour", "join_weather_15m", "fill_forward", "fill_backward", "fill_linear",
              "fill_constant", "fault_lifecycle", "fault_records_cleared", "finding_candidates", "finding_scores", "finding_scope"}
#: Counts over all buildings, where the series of a building stay apart by their key only.
FLEET = {"append_report", "compare_results", "analyze_quality", "ingest_quality_gate", "preset_coverage", "tuning_delta", "tuning_hints",
         "results_listing", "top_fault_rules"}
#: A list over all buildings.
LISTS = {"top_faulted"}
#: Texts that name the building themselves, or don't depend on it.
AS_THEY_ARE = {"page_of_rows", "inspect_page", "economizer_top_points", "column_profile", "weather_bins", "schedule_savings"}

_SOURCES = (history_sql(), RAW_HISTORY_SQL)


def _scoped(sql: str, building: str) -> str:
    for source in _SOURCES:
        sql = sql.replace(source, f"SELECT * FROM ({source}) WHERE building_id = '{building}'")
    return sql.replace("@SITE@", building)


def _joined(sql: str) -> str:
    for source in _SOURCES:
        sql = sql.replace(source, f"SELECT * REPLACE (building_id || '/' || equipment_id AS equipment_id) FROM ({source})")
    return sql


def _by_building(name: str, sql: str) -> str:
    if name in AS_THEY_ARE or not any(source in sql for source in _SOURCES):
        return sql
    if name in FLEET:
        return _joined(sql)
    if name in LISTS:
        return ("SELECT split_part(equipment_id, '/', 1) AS building_id, split_part(equipment_id, '/', 2) AS equipment_id, * EXCLUDE (equipment_id) "
                f"FROM ({_joined(sql)})")
    label = "" if name in UNLABELLED else "'{0}' AS building_id, "
    return " UNION ALL ".join(f"SELECT {label.format(b)}* FROM ({_scoped(sql, b)})" for b in BUILDINGS)


ORACLES: dict[str, str] = {"rule_" + k.lower().replace("-", "_"): v for k, v in rule_sql().items()}
ORACLES["rules_all"] = all_rules_sql()
ORACLES["rules_without_weather"] = without_weather_sql()
ORACLES.update(CORE)
ORACLES.update(ANALYTICS)
ORACLES = {name: _by_building(name, sql) for name, sql in ORACLES.items()}
