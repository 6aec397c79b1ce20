"""The rule catalogue: 66 definitions, each a predicate over role columns.

A rule never touches data itself. `raw` is the fault predicate; `steps` adds the window
columns it reads (a list, because a later step may read an earlier one) and `lookback`
says how many earlier rows they need. The runner evaluates any number of rules in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window, functions as F

from thermaline.functions.roles import EQ, ID
from thermaline.functions.logic import (
    any_of, chiller_proof, energized, epoch, fan_on, frac, frac15, holds, hydronic_on, num,
    percent, present, smaller, unoccupied, unoccupied_or_zero)
from thermaline.operators.confirm import confirm_row_count, min_periods, window_rows

C = F.col


@dataclass(frozen=True)
class Rule:
    id: str
    kinds: tuple[str, ...]
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)      # name -> (default, min, max)
    confirm: int = 0                                # seconds
    raw: Callable[[dict], Column] | None = None
    steps: Callable | None = None                   # (params, window) -> [dict, ...]
    lookback: Callable[[dict], int] = lambda p: 0
    where: Callable[[], Column] | None = None       # rows the rule sees at all
    drops_rows: bool = False                        # `where` removes rows inside a series
    weather: bool = False                           # reads wx_* columns
    extra_rows: Callable[[dict], int] = lambda p: 0  # added to the confirm rows
    aggs: Callable[[dict], dict] | None = None      # rules without a confirm tail
    pct: bool = False                               # also reports fault_pct
    keep: Callable[[dict], Column] | None = None    # whole-series condition (an aggregate)

    def settings(self, poll: float = 300.0, **over) -> dict:
        p = {k: float(v[0]) for k, v in self.params.items()} | {"confirm_seconds": float(self.confirm)}
        unknown = set(over) - set(p)
        if unknown:
            raise KeyError(f"{self.id}: unknown parameter(s) {sorted(unknown)}")
        for k, v in over.items():
            lo, hi = self.params[k][1:] if k in self.params else (0.0, float("inf"))
            p[k] = min(max(float(v), lo), hi)
        p["poll"] = float(poll)
        return p

    def confirm_rows(self, p: dict) -> int:
        return confirm_row_count(p["confirm_seconds"], p["poll"]) + self.extra_rows(p)

    @property
    def tag(self) -> str:
        return "_" + self.id.lower().replace("-", "_")


RULES: dict[str, Rule] = {}


def rule(id, kinds, required, optional="", confirm=0, *, raw=None, params=None, **kw):
    RULES[id] = Rule(id, tuple(kinds.split()), tuple(required.split()), tuple(optional.split()),
                     params or {}, confirm, raw, **kw)


def P(p, name):
    """A parameter: a number, or a column where it differs from equipment to equipment."""
    return p[name] if isinstance(p[name], Column) else num(p[name])


AHU, VAV, CHILLER = "ahu", "vav", "chiller"
SWEEP = "ahu vav chiller boiler weather zone heatpump"
FAN = "fan_status fan_cmd"
HYDRO = "pump_status chiller_status chw_flow chw_pump_cmd"
TOL, SAT_RISE, MIX = 1.15, 0.55, 1.626345153  # fixed values of the fault equations
ZONE_BAND = {"zone_t_lo": (68.0, 60.0, 72.0), "zone_t_hi": (76.0, 72.0, 85.0)}


def zero(c) -> Column:
    return F.coalesce(frac(c), num(0))


def _hours(n: Column, p) -> Column:
    return n * num(p["poll"]) / num(3600)


# --- aggregates without a confirmation tail -------------------------------------------------
rule("FAN-RUNTIME-HOURS", "", "fan_cmd", where=lambda: present("fan_cmd"), aggs=lambda p: {
    "fan_runtime_hours": _hours(F.sum((frac("fan_cmd") > num(0.05)).cast("int")), p),
    "total_hours": _hours(F.count(F.lit(1)), p)})
rule("AVG-ZONE-TEMP", "", "zone_t", params=ZONE_BAND, where=lambda: present("zone_t"), aggs=lambda p: {
    "avg_zone_temp": F.avg("zone_t"), "min_zone_temp": F.min("zone_t"), "max_zone_temp": F.max("zone_t")})
rule("ZONE-COMFORT-PCT", "", "zone_t", params=ZONE_BAND, where=lambda: present("zone_t"), aggs=lambda p: {
    "comfort_pct": num(100) * F.avg(C("zone_t").between(p["zone_t_lo"], p["zone_t_hi"]).cast("int"))})
# The sample count keeps the fixed 68..76 band whatever the parameters say.
rule("FAULT-ELAPSED-HOURS", "", "zone_t", params=ZONE_BAND, where=lambda: present("zone_t"), aggs=lambda p: {
    "fault_samples": F.sum((~C("zone_t").between(68.0, 76.0)).cast("int")),
    "fault_hours": _hours(F.sum((~C("zone_t").between(p["zone_t_lo"], p["zone_t_hi"])).cast("int")), p)})

# --- zones and terminals --------------------------------------------------------------------
rule("VAV-1", "vav zone", "zone_t", "occ_mode", 900, pct=True, drops_rows=True,
     params={"zone_t_lo": (70.0, 55.0, 72.0), "zone_t_hi": (75.0, 72.0, 85.0)},
     where=lambda: present("zone_t"),
     raw=lambda p: ~C("zone_t").between(p["zone_t_lo"], p["zone_t_hi"]) & ~holds(unoccupied(zone=True)))
rule("VAV-2", "vav zone", "zone_t occ_mode", "", 900, params={"setback_hi": (68.0, 55.0, 72.0)},
     raw=lambda p: unoccupied(zone=True) & (C("zone_t") > P(p, "setback_hi")))


def _air_moving(p) -> Column:
    return F.coalesce(C("zone_flow"), num(0)) > P(p, "flow_on_min")


FLOW_ON = {"flow_on_min": (25.0, 0.0, 200.0)}
rule("VAV-3", VAV, "oa_t reheat_valve_pct zone_flow", FAN, 300,
     params={"reheat_oat": (78.0, 65.0, 90.0), "reheat_pct": (0.52, 0.1, 1.0), **FLOW_ON},
     raw=lambda p: fan_on() & _air_moving(p) & (C("oa_t") > P(p, "reheat_oat"))
     & (frac("reheat_valve_pct") > P(p, "reheat_pct")))
rule("VAV-4", VAV, "damper_pct zone_flow", FAN, 900,
     params={"full_open_pct": (0.975, 0.8, 1.0), "sustain_hours": (1.5, 0.5, 6.0), **FLOW_ON},
     extra_rows=lambda p: window_rows(p["sustain_hours"], p["poll"], least=0) - 1,
     raw=lambda p: fan_on() & _air_moving(p) & (frac("damper_pct") > P(p, "full_open_pct")))
rule("VAV-5", VAV, "zone_flow damper_pct", FAN, 900,
     raw=lambda p: fan_on() & (C("zone_flow") > num(50)) & (frac("damper_pct") < num(0.1)))
rule("VAV-6", VAV, "oa_t reheat_valve_pct", "clg_available", 900,
     params={"free_cool_oat": (65.0, 45.0, 75.0), "reheat_pct": (0.25, 0.05, 1.0)},
     raw=lambda p: (F.coalesce(C("clg_available"), num(1)) > num(0.05))
     & (C("oa_t") < P(p, "free_cool_oat")) & (frac("reheat_valve_pct") > P(p, "reheat_pct")))
rule("VAV-REHEAT", VAV, "reheat_valve_pct vav_discharge_t vav_inlet_t zone_flow", FAN, 900,
     params={"reheat_cmd": (0.3, 0.1, 1.0), "min_rise": (3.0, 0.5, 15.0), **FLOW_ON},
     raw=lambda p: fan_on() & _air_moving(p) & (frac("reheat_valve_pct") > P(p, "reheat_cmd"))
     & (C("vav_discharge_t") - C("vav_inlet_t") < P(p, "min_rise")))
rule("VAV-AHU-LEAVE", VAV, "vav_discharge_t ahu_sat zone_flow", FAN, 900,
     params={"delta_f": (8.0, 2.0, 25.0), **FLOW_ON},
     raw=lambda p: fan_on() & _air_moving(p)
     & (F.abs(C("vav_discharge_t") - C("ahu_sat")) > P(p, "delta_f")))


def _vav7_rows(p) -> int:
    return window_rows(p["fixed_flow_hours"], p["poll"], least=6)


def _vav7_steps(p, w):
    roll = w.rowsBetween(1 - _vav7_rows(p), 0)
    return [{"_vav_7_std": F.stddev_samp("zone_flow").over(roll), "_vav_7_mean": F.avg("zone_flow").over(roll),
             "_vav_7_n": F.count("zone_flow").over(roll)}]


def _vav7_raw(p):
    steady = ((C("_vav_7_n") >= F.lit(min_periods(_vav7_rows(p))))
              & (C("_vav_7_std") < P(p, "fixed_flow_max_std")))
    starved = (C("zone_flow") > P(p, "flow_on_min")) & (C("zone_flow") < C("min_flow_sp"))
    return fan_on() & present("zone_flow") & any_of([
        starved, steady & (C("_vav_7_mean") > P(p, "fixed_flow_min_mean")),
        steady & (C("min_flow_sp") > P(p, "high_min_flow_sp"))])


rule("VAV-7", VAV, "zone_flow", "min_flow_sp " + FAN, 900, raw=_vav7_raw, steps=_vav7_steps,
     lookback=lambda p: _vav7_rows(p) - 1,
     params={"high_min_flow_sp": (250.0, 50.0, 2000.0), "fixed_flow_hours": (1.0, 0.25, 6.0),
             "fixed_flow_max_std": (15.0, 1.0, 80.0), "fixed_flow_min_mean": (200.0, 50.0, 2000.0), **FLOW_ON})

# --- air handlers ---------------------------------------------------------------------------
rule("OAT-METEO", AHU, "oa_t", "web_oa_t", 900, pct=True, weather=True,
     params={"oat_err": (5.0, 2.0, 20.0)}, where=lambda: C(EQ).startswith("AHU"),
     raw=lambda p: F.abs(C("oa_t") - F.coalesce(C("web_oa_t"), C("wx_oa_t"))) > P(p, "oat_err"))
rule("FC1", AHU, "duct_static duct_static_sp fan_cmd", FAN, 300,
     params={"eps_dsp": (0.12, 0.0, 0.5), "eps_vfd_spd": (0.13, 0.0, 0.5)},
     raw=lambda p: fan_on() & (C("duct_static") < C("duct_static_sp") - P(p, "eps_dsp"))
     & (frac("fan_cmd") >= num(1) - P(p, "eps_vfd_spd")))
rule("FC2", AHU, "mat oa_t rat fan_cmd", FAN, 600,
     raw=lambda p: fan_on() & present("rat", "oa_t")
     & (C("mat") + num(TOL) < smaller("rat", "oa_t") - num(TOL)))
rule("FC3", AHU, "mat oa_t rat fan_cmd", FAN, 600,
     raw=lambda p: fan_on() & (zero("fan_cmd") > num(0.01)) & (C("mat") - num(TOL) > C("rat") + num(TOL))
     & (C("mat") - num(TOL) > C("oa_t") + num(TOL)))


def _os_mode() -> Column:
    fan = F.coalesce((C("fan_status") > num(0.05)).cast("double"), frac("fan_cmd"))
    return (F.when(fan.isNull() | (fan < num(0.05)), 0).when(frac("clg_valve_pct") > num(0.1), 3)
            .when(frac("oa_damper_pct") > num(0.5), 2).otherwise(1))


def _fc4_steps(p, w):
    # Hours never straddle blocks, so the hourly count stays inside the block's partition:
    # ordering by the hour with a zero-width range frame covers exactly the rows of that hour.
    prev = F.lag("_fc4_mode").over(w)
    entered = holds((C("_fc4_mode") != F.lit(0)) & (C("_fc4_mode") != prev))
    hour = Window.partitionBy(*ID, "_block").orderBy("_fc4_hour").rangeBetween(0, 0)
    return [{"_fc4_mode": _os_mode(), "_fc4_hour": F.expr("unix_micros(timestamp_utc) div 3600000000")},
            {"_fc4_in": F.when(entered, C("_fc4_mode"))},
            {f"_fc4_n{m}": F.count(F.when(C("_fc4_in") == F.lit(m), 1)).over(hour) for m in (1, 2, 3)}]


rule("FC4", AHU, "oa_damper_pct clg_valve_pct fan_cmd", "fan_status", 3600, steps=_fc4_steps,
     lookback=lambda p: 1, params={"delta_os_max": (5.0, 1.0, 30.0)},
     raw=lambda p: F.greatest("_fc4_n1", "_fc4_n2", "_fc4_n3").cast("double") > P(p, "delta_os_max"))
MIX_TOL = {"mix_tol": (1.15, 0.0, 10.0)}
rule("FC5", AHU, "sat mat htg_valve_pct fan_cmd", FAN, 600,
     params={**MIX_TOL, "htg_on_min": (0.01, 0.0, 0.25)},
     raw=lambda p: fan_on() & (frac("fan_cmd") >= num(0.05)) & (frac("htg_valve_pct") > P(p, "htg_on_min"))
     & (C("sat") + P(p, "mix_tol") <= C("mat") - P(p, "mix_tol") + num(SAT_RISE)))


def oa_fraction() -> Column:
    return F.try_divide(C("mat") - C("rat"), C("oa_t") - C("rat"))


rule("FC6", AHU, "mat rat oa_t fan_cmd vav_total_flow", FAN, 600,
     params={"airflow_err": (0.15, 0.05, 1.0), "delta_t_min": (5.0, 0.0, 30.0),
             "min_cfm_design": (5000.0, 0.0, 200000.0)},
     raw=lambda p: fan_on() & (C("vav_total_flow") > num(0)) & (frac("fan_cmd") >= num(0.05))
     & (F.abs(C("rat") - C("oa_t")) >= P(p, "delta_t_min"))
     & (F.abs(oa_fraction() - F.try_divide(P(p, "min_cfm_design"), C("vav_total_flow"))) > P(p, "airflow_err")))
rule("FC7", AHU, "sat sat_sp htg_valve_pct", FAN, 600,
     params={"sat_err": (1.0, 0.0, 10.0), "htg_full_min": (0.9, 0.5, 1.0)},
     raw=lambda p: fan_on(False) & (C("sat") < C("sat_sp") - P(p, "sat_err"))
     & (zero("htg_valve_pct") >= P(p, "htg_full_min")))


def _economizing():
    return (zero("oa_damper_pct") > num(0.05)) & (zero("clg_valve_pct") < num(0.1))


def _cooling_full_oa():
    return (zero("clg_valve_pct") > num(0.01)) & (zero("oa_damper_pct") > num(0.9))


rule("FC8", AHU, "sat mat oa_damper_pct clg_valve_pct", FAN, 600,
     raw=lambda p: fan_on() & _economizing() & (F.abs(C("sat") - num(SAT_RISE) - C("mat")) > num(MIX)))
rule("FC9", AHU, "oa_t sat_sp oa_damper_pct clg_valve_pct", FAN, 600,
     raw=lambda p: fan_on() & _economizing() & (C("oa_t") - num(TOL) > C("sat_sp") - num(SAT_RISE) + num(TOL)))
rule("FC10", AHU, "mat oa_t oa_damper_pct clg_valve_pct", FAN, 600,
     raw=lambda p: fan_on() & _cooling_full_oa() & (F.abs(C("mat") - C("oa_t")) > num(MIX)))
rule("FC11", AHU, "oa_t sat_sp oa_damper_pct clg_valve_pct", FAN, 600,
     raw=lambda p: fan_on() & _cooling_full_oa()
     & (C("oa_t") + num(TOL) < C("sat_sp") - num(SAT_RISE) - num(TOL)))
rule("FC12", AHU, "sat mat oa_damper_pct clg_valve_pct", FAN, 600,
     raw=lambda p: fan_on() & (zero("clg_valve_pct") > num(0.01))
     & (C("sat") - num(TOL) - num(SAT_RISE) > C("mat") + num(TOL))
     & ((zero("oa_damper_pct") <= num(0.05)) | (zero("oa_damper_pct") > num(0.9))))
rule("FC13-SAT-HIGH", AHU, "sat sat_sp clg_valve_pct oa_damper_pct", FAN, 600,
     params={"sat_err": (1.0, 0.0, 10.0), "clg_valve_min": (0.01, 0.0, 0.5),
             "oa_damper_econ_low": (0.05, 0.0, 0.5), "oa_damper_econ_high": (0.9, 0.5, 1.0)},
     raw=lambda p: fan_on() & (zero("clg_valve_pct") > P(p, "clg_valve_min"))
     & (C("sat") > C("sat_sp") + P(p, "sat_err"))
     & ((zero("oa_damper_pct") <= P(p, "oa_damper_econ_low"))
        | (zero("oa_damper_pct") > P(p, "oa_damper_econ_high"))))


def _coil_dt(p, enter, leave):
    return (F.abs(F.coalesce(C(enter), C("mat")) - F.coalesce(C(leave), C("sat")))
            >= F.sqrt(num(2) * P(p, "mix_tol") * P(p, "mix_tol")) + num(SAT_RISE))


rule("FC14", AHU, "clg_valve_pct",
     "cooling_coil_entering_temp cooling_coil_leaving_temp mat sat oa_damper_pct " + FAN, 600, params=MIX_TOL,
     raw=lambda p: fan_on() & (zero("fan_cmd") >= num(0.05)) & (zero("clg_valve_pct") <= num(0.01))
     & _coil_dt(p, "cooling_coil_entering_temp", "cooling_coil_leaving_temp"))
rule("FC15", AHU, "", "heating_coil_entering_temp heating_coil_leaving_temp mat sat htg_valve_pct "
     "clg_valve_pct " + FAN, 600, params=MIX_TOL,
     raw=lambda p: fan_on() & (zero("fan_cmd") >= num(0.05)) & (zero("htg_valve_pct") <= num(0.01))
     & (zero("clg_valve_pct") <= num(0.01))
     & _coil_dt(p, "heating_coil_entering_temp", "heating_coil_leaving_temp"))
rule("AHU-SATDEV", AHU, "sat sat_sp", FAN, 600, params={"sat_dev_err": (5.0, 1.0, 15.0)},
     raw=lambda p: fan_on(False) & (F.abs(C("sat") - C("sat_sp")) > P(p, "sat_dev_err")))
rule("AHU-DUCTHI", AHU, "duct_static duct_static_sp fan_cmd", FAN, 300,
     params={"duct_high_margin": (0.25, 0.05, 1.0), "pressure_on_min": (0.2, 0.05, 1.0)},
     raw=lambda p: F.coalesce(fan_on(None), F.abs(C("duct_static")) > P(p, "pressure_on_min"))
     & (C("duct_static") > C("duct_static_sp") + P(p, "duct_high_margin")))
rule("AHU-SIMUL", AHU, "htg_valve_pct clg_valve_pct", FAN, 300, params={"valve_open_pct": (0.1, 0.05, 0.5)},
     raw=lambda p: fan_on() & (frac("htg_valve_pct") > P(p, "valve_open_pct"))
     & (frac("clg_valve_pct") > P(p, "valve_open_pct")))
rule("CMD-1", AHU, "fan_cmd fan_status", "", 600,
     raw=lambda p: (frac("fan_cmd") >= num(0.05)) != (C("fan_status") > num(0.5)))
rule("OA-1", AHU, "mat rat oa_t fan_cmd", FAN, 900,
     params={"min_oa_frac": (0.15, 0.05, 0.4), "oat_rat_guard": (2.2, 0.5, 6.0)},
     raw=lambda p: fan_on() & (F.abs(C("rat") - C("oa_t")) > P(p, "oat_rat_guard"))
     & (oa_fraction() < P(p, "min_oa_frac")) & (frac("fan_cmd") >= num(0.05)))
rule("DMP-1", AHU, "oa_damper_pct oa_t mat", FAN, 900, params={"leak_delta": (2.0, 0.5, 6.0)},
     raw=lambda p: fan_on() & (frac("oa_damper_pct") <= num(0.05))
     & (F.abs(C("mat") - C("oa_t")) < P(p, "leak_delta")))
rule("VLV-1", AHU, "clg_valve_pct sat sat_sp mat", FAN, 900,
     params={"sat_err": (2.0, 0.5, 8.0), "mat_leak_delta": (2.0, 0.5, 12.0)},
     raw=lambda p: fan_on() & (frac("clg_valve_pct") <= num(0.05))
     & any_of([C("sat") < C("sat_sp") - P(p, "sat_err"), C("sat") < C("mat") - P(p, "mat_leak_delta")]))
rule("RESET-1", AHU, "sat_sp oa_t", FAN, 900,
     params={"reset_err_f": (3.0, 0.5, 10.0), "reset_sat_at_65": (52.0, 45.0, 65.0),
             "reset_slope": (0.25, 0.05, 1.0), "reset_oat_ref": (65.0, 50.0, 80.0)},
     raw=lambda p: fan_on(command=0.05) & (F.abs(C("sat_sp") - (P(p, "reset_sat_at_65") + P(p, "reset_slope")
                                                      * (C("oa_t") - P(p, "reset_oat_ref")))) > P(p, "reset_err_f")))
rule("TRIM-1", AHU, "duct_static", "duct_static_sp static_reset_request " + FAN, 1800,
     params={"duct_hi": (1.35, 0.5, 3.0), "request_lo": (1.0, 0.0, 10.0)},
     raw=lambda p: (F.coalesce(C("duct_static"), C("duct_static_sp")) > P(p, "duct_hi"))
     & (F.coalesce(C("static_reset_request"), num(0)) <= P(p, "request_lo")) & fan_on())
rule("SCHED-1", AHU, "occ_mode fan_status", "zone_t", 1800,
     params={"comfort_low_f": (70.0, 50.0, 80.0), "comfort_high_f": (75.0, 55.0, 90.0)},
     raw=lambda p: (C("fan_status") > num(0.5)) & unoccupied_or_zero()
     & (C("zone_t").isNull() | C("zone_t").between(p["comfort_low_f"], p["comfort_high_f"])))

# --- economizers ----------------------------------------------------------------------------
rule("ECON-1", AHU, "fan_cmd oa_damper_pct oa_t", FAN, 600,
     params={"econ1_oat_min": (55.0, 45.0, 70.0), "econ1_damper_max": (0.05, 0.0, 0.2)},
     raw=lambda p: F.coalesce(frac15("fan_cmd") > num(0.01), C("fan_status") > num(0.5), F.lit(False))
     & (frac15("oa_damper_pct") < P(p, "econ1_damper_max")) & (C("oa_t") > P(p, "econ1_oat_min")))
rule("ECON-2", AHU, "oa_t oa_damper_pct", FAN, 300,
     params={"econ2_oat_hi": (63.0, 55.0, 80.0), "econ2_damper": (0.42, 0.2, 0.9)},
     raw=lambda p: (C("oa_t") > P(p, "econ2_oat_hi")) & (frac15("oa_damper_pct") > P(p, "econ2_damper")))


def web_t() -> Column:
    return F.coalesce(C("web_oa_t"), C("wx_web_oa_t"))


def web_dp() -> Column:
    return F.coalesce(C("web_oa_dp"), C("wx_web_oa_dp"))


def _free_cooling_weather(p, n):
    return ((web_t() >= P(p, f"econ{n}_db_min")) & (web_t() < P(p, f"econ{n}_db_max"))
            & (web_dp() < P(p, f"econ{n}_dp_max")))


rule("ECON-3", AHU, "oa_damper_pct clg_valve_pct", "web_oa_t web_oa_dp " + FAN, 300, weather=True,
     params={"econ3_db_min": (60.0, 50.0, 68.0), "econ3_db_max": (72.0, 65.0, 80.0),
             "econ3_dp_max": (60.0, 45.0, 68.0), "econ3_damper_hi": (0.9, 0.5, 1.0)},
     raw=lambda p: fan_on() & _free_cooling_weather(p, 3) & (frac("clg_valve_pct") > num(0.01))
     & (frac("oa_damper_pct") < P(p, "econ3_damper_hi")))
rule("ECON-4", AHU, "mat rat oa_t fan_cmd", FAN, 600, params={"oa_min_pct": (21.0, 5.0, 40.0)},
     raw=lambda p: fan_on() & (zero("fan_cmd") > num(0.01)) & (F.abs(C("rat") - C("oa_t")) > num(2.2))
     & (oa_fraction() * num(100) < P(p, "oa_min_pct")))
rule("ECON-5", AHU, "preheat_leave_t sat_sp oa_t htg_valve_pct", FAN, 600,
     params={"preheat_over_f": (2.2, 0.5, 8.0)},
     raw=lambda p: fan_on() & present("preheat_leave_t", "sat_sp", "oa_t") & (zero("htg_valve_pct") > num(0.01))
     & (((C("oa_t") > C("sat_sp")) & (C("preheat_leave_t") - C("oa_t") > P(p, "preheat_over_f")))
        | ((C("oa_t") < C("sat_sp")) & (C("preheat_leave_t") - C("sat_sp") > P(p, "preheat_over_f")))))
rule("ECON-6", AHU, "oa_damper_pct", "web_oa_t " + FAN, 600, weather=True,
     params={"econ6_oat_max_f": (25.0, 15.0, 40.0), "econ6_damper_max": (0.25, 0.05, 0.5)},
     raw=lambda p: fan_on() & (web_t() < P(p, "econ6_oat_max_f"))
     & (frac("oa_damper_pct") > P(p, "econ6_damper_max")))
rule("ECON-7", AHU, "oa_damper_pct clg_valve_pct", "web_oa_t web_oa_dp " + FAN, 600, weather=True,
     params={"econ7_db_min": (35.0, 20.0, 50.0), "econ7_db_max": (72.0, 65.0, 80.0),
             "econ7_dp_max": (60.0, 45.0, 68.0), "econ7_damper_min": (0.5, 0.2, 0.9)},
     raw=lambda p: fan_on() & _free_cooling_weather(p, 7) & (frac("clg_valve_pct") > num(0.05))
     & (frac("oa_damper_pct") < P(p, "econ7_damper_min")))
rule("MECH-OAT-1", "ahu chiller heatpump", "web_oa_t", "clg_valve_pct chiller_status", 600,
     params={"mech_oat_max_f": (60.0, 45.0, 65.0)},
     raw=lambda p: (C("web_oa_t") < P(p, "mech_oat_max_f"))
     & any_of([C("chiller_status") > num(0.05), frac("clg_valve_pct") > num(0.05)]))

# --- sensor validation ----------------------------------------------------------------------
# Hard limits (low, high) scaled by a parameter, and unscaled ones.
RANGE_LIMITS = {
    "oa_t": (-60.0, 130.0), "mat": (-20.0, 110.0), "zone_t": (40.0, 100.0), "rat": (40.0, 100.0),
    "sat": (30.0, 150.0), "chw_supply_t": (30.0, 80.0), "chw_return_t": (30.0, 90.0),
    "hw_supply_t": (40.0, 220.0), "hw_return_t": (40.0, 220.0)}
RANGE_FIXED = {"oa_h": (0.0, 100.0), "duct_static": (-1.0, 8.0)}
# Largest credible step between samples.
SPIKE_LIMITS = {"oa_t": 36.0, "mat": 25.0, "zone_t": 12.0, "rat": 12.0, "sat": 40.0, "chw_supply_t": 20.0,
                "chw_return_t": 20.0, "hw_supply_t": 60.0, "hw_return_t": 60.0, "oa_h": 25.0, "duct_static": 2.0}
HELD_ROLES = list(RANGE_LIMITS) + ["oa_h"]
RATE_ROLES = ["oa_t", "mat", "zone_t", "rat", "sat"]
PROOFS = " fan_status fan_cmd pump_status chw_pump_cmd chiller_status"
SWEPT = " ".join(SPIKE_LIMITS) + PROOFS


def out_of_range(role: str, scale: float) -> Column:
    lo, hi = RANGE_FIXED.get(role) or tuple(scale * v for v in RANGE_LIMITS[role])
    return (C(role) < num(lo)) | (C(role) > num(hi))


rule("SV-RANGE", SWEEP, "", SWEPT, 300, params={"range_scale_temperature": (1.0, 0.5, 2.0)},
     raw=lambda p: energized() & any_of(out_of_range(r, p["range_scale_temperature"])
                                        for r in {**RANGE_LIMITS, **RANGE_FIXED}))


def held_columns(tag: str, rows: int, w) -> dict:
    roll = w.rowsBetween(1 - rows, 0)
    return {f"{tag}_span_{r}": F.when(F.count(r).over(roll) >= F.lit(rows),
                                      F.max(r).over(roll) - F.min(r).over(roll)) for r in HELD_ROLES}


def _flat_rows(p):
    return window_rows(p["flatline_hours"], p["poll"])


def _stale_rows(p):
    return window_rows(p["stale_hours"], p["poll"])


rule("SV-FLATLINE", SWEEP, "", " ".join(HELD_ROLES) + PROOFS, 300,
     params={"flatline_tol": (0.1, 0.02, 1.0), "flatline_hours": (1.0, 0.25, 12.0)},
     steps=lambda p, w: [held_columns("_sv_flatline", _flat_rows(p), w)], lookback=lambda p: _flat_rows(p) - 1,
     raw=lambda p: energized() & any_of(C(f"_sv_flatline_span_{r}") <= P(p, "flatline_tol") for r in HELD_ROLES))
rule("SV-SPIKE", SWEEP, "", SWEPT, 300, params={"spike_scale": (1.0, 0.25, 3.0)},
     steps=lambda p, w: [{f"_sv_spike_{r}": F.abs(C(r) - F.lag(r).over(w)) for r in SPIKE_LIMITS}],
     lookback=lambda p: 1,
     raw=lambda p: energized() & any_of(C(f"_sv_spike_{r}") > num(v * p["spike_scale"])
                                        for r, v in SPIKE_LIMITS.items()))
# Every role with a full window must have held still, and there must be one.
rule("SV-STALE", SWEEP, "", " ".join(HELD_ROLES), 300,
     params={"stale_hours": (2.0, 0.5, 12.0), "stale_tol": (0.05, 0.0, 1.0)},
     steps=lambda p, w: [held_columns("_sv_stale", _stale_rows(p), w)], lookback=lambda p: _stale_rows(p) - 1,
     raw=lambda p: F.greatest(*[C(f"_sv_stale_span_{r}") for r in HELD_ROLES]) <= P(p, "stale_tol"))


def _rate_steps(p, w):
    dt = (epoch() - epoch(F.lag("timestamp_utc").over(w)))
    moved = F.greatest(*[F.abs(C(r) - F.lag(r).over(w)) for r in RATE_ROLES])
    return [{"_sv_rate_dt": dt, "_sv_rate_moved": moved},
            {"_sv_rate_over": holds((C("_sv_rate_dt") > num(0)) & (C("_sv_rate_dt") <= num(p["persistence_min"] * 60))
                                    & (F.try_divide(C("_sv_rate_moved"), C("_sv_rate_dt") / num(3600))
                                       > P(p, "steady_fault_per_hour")))},
            {"_sv_rate_prev": F.lag("_sv_rate_over").over(w)}]


rule("SV-RATE", SWEEP, "", " ".join(RATE_ROLES), 600, steps=_rate_steps, lookback=lambda p: 2,
     params={"persistence_min": (10.0, 5.0, 60.0), "steady_fault_per_hour": (6.0, 1.0, 60.0)},
     raw=lambda p: C("_sv_rate_over") & C("_sv_rate_prev"))

OUTPUT_ROLES = ["oa_damper_pct", "clg_valve_pct", "htg_valve_pct", "damper_pct"]


def hunting_steps(p, w, out: Column, tag: str) -> list[dict]:
    """Deadbanded movement, direction reversals and rolling totals of one control output."""
    n = window_rows(p["window_hours"], p["poll"])
    roll = w.rowsBetween(1 - n, 0)
    o, d = C(f"{tag}_out"), C(f"{tag}_delta")
    move = o - F.lag(o).over(w)
    return [{f"{tag}_out": out},
            {f"{tag}_delta": F.when(F.abs(move) >= P(p, "change_deadband_pct"), move)
                              .when(move.isNotNull(), num(0))},
            {f"{tag}_turn": holds(d * F.lag(d).over(w) < num(0)).cast("int")},
            {f"{tag}_n": F.count(o).over(roll), f"{tag}_span": F.max(o).over(roll) - F.min(o).over(roll),
             f"{tag}_tv": F.sum(F.coalesce(F.abs(d), num(0))).over(roll),
             f"{tag}_turns": F.sum(f"{tag}_turn").over(roll)}]


def hunting(p, tag: str) -> Column:
    need = -(-window_rows(p["window_hours"], p["poll"]) * p["minimum_coverage_pct"] // 100.0)
    span, tv = C(f"{tag}_span"), C(f"{tag}_tv")
    return (present(f"{tag}_out") & (C(f"{tag}_n") >= F.lit(int(need)))
            & (span >= P(p, "minimum_span_pct")) & (span > num(0))
            & (tv >= P(p, "total_variation_fault_pct"))
            & (F.try_divide(tv, num(2) * span) >= P(p, "minimum_equivalent_cycles"))
            & (C(f"{tag}_turns").cast("double") >= P(p, "minimum_reversals")))


HUNT_PARAMS = {"window_hours": (1.0, 0.25, 4.0), "change_deadband_pct": (1.0, 0.0, 10.0),
               "minimum_span_pct": (20.0, 5.0, 100.0), "total_variation_fault_pct": (500.0, 50.0, 2000.0),
               "minimum_equivalent_cycles": (2.5, 0.5, 10.0), "minimum_reversals": (4.0, 1.0, 20.0),
               "minimum_coverage_pct": (80.0, 50.0, 100.0)}


def loop_active() -> Column:
    return fan_on() & (F.coalesce(C("loop_enabled"), num(1)) > num(0.05))


rule("PID-HUNT-1", "ahu vav chiller boiler heatpump", "",
     " ".join(OUTPUT_ROLES) + " loop_enabled " + FAN, 0, params=HUNT_PARAMS,
     steps=lambda p, w: hunting_steps(p, w, F.coalesce(*[percent(r) for r in OUTPUT_ROLES]), "_pid"),
     lookback=lambda p: window_rows(p["window_hours"], p["poll"]) + 2,
     raw=lambda p: loop_active() & hunting(p, "_pid"))
rule("WX-1", "weather", "oa_t", "", 300, params={"spike_limit": (16.0, 4.0, 40.0)},
     steps=lambda p, w: [{"_wx_1_step": F.abs(C("oa_t") - F.lag("oa_t").over(w))}], lookback=lambda p: 1,
     raw=lambda p: C("_wx_1_step") > P(p, "spike_limit"))

# --- plant ----------------------------------------------------------------------------------
def load_satisfied() -> Column:
    return F.coalesce(C("building_zone_load_satisfied"), C("building_ahu_load_satisfied"))


rule("CHW-NOLOAD-1", CHILLER, "", "chiller_status chiller_cmd chw_pump_status chw_pump_cmd "
     "building_zone_load_satisfied building_ahu_load_satisfied", 1800,
     raw=lambda p: (load_satisfied() > num(0.5)) & any_of([
         C("chiller_status") > num(0.05), C("chiller_cmd") > num(0.05),
         C("chw_pump_status") > num(0.05), frac("chw_pump_cmd") > num(0.05)]))
rule("CHW-1", CHILLER, "chw_supply_t chw_return_t", HYDRO + " chiller_current chiller_amps chiller_power", 900,
     params={"min_dt": (4.0, 1.0, 12.0)},
     raw=lambda p: chiller_proof() & (C("chw_return_t") - C("chw_supply_t") < P(p, "min_dt")))
PUMP_HI = {"pump_hi": (0.87, 0.5, 1.0)}
rule("CHW-2", CHILLER, "chw_dp chw_dp_sp chw_pump_cmd", "pump_status chiller_status chw_flow", 300,
     params={"dp_margin": (2.2, 0.5, 6.0), **PUMP_HI},
     raw=lambda p: hydronic_on() & (frac("chw_pump_cmd") >= P(p, "pump_hi"))
     & (C("chw_dp") < C("chw_dp_sp") - P(p, "dp_margin")))
rule("CHW-3", CHILLER, "chw_supply_t chw_supply_sp chw_pump_cmd", "pump_status chiller_status chw_flow", 300,
     params={"sp_band": (2.2, 0.5, 6.0)},
     raw=lambda p: hydronic_on() & (F.abs(C("chw_supply_t") - C("chw_supply_sp")) > P(p, "sp_band")))
rule("CHW-4", CHILLER, "chw_flow chw_pump_cmd", "pump_status chiller_status", 300,
     params={"flow_hi": (1100.0, 200.0, 3000.0), **PUMP_HI},
     raw=lambda p: hydronic_on(flow=False) & (frac("chw_pump_cmd") >= P(p, "pump_hi"))
     & (C("chw_flow") > P(p, "flow_hi")))
TOWER = "chiller cooling_tower"
APPROACH, FAN_HI = {"cw_approach": (7.0, 3.0, 15.0)}, {"tower_fan_hi": (0.95, 0.8, 1.0)}
rule("CW-OPT-1", TOWER, "cw_supply_t web_wb_t", HYDRO, 900, params={**APPROACH, "cw_slack": (2.0, 0.5, 6.0)},
     raw=lambda p: hydronic_on() & (C("cw_supply_t") < C("web_wb_t") + P(p, "cw_approach") - P(p, "cw_slack")))
rule("CW-APR-1", TOWER, "cw_supply_t web_wb_t tower_fan_cmd", HYDRO, 900,
     params={"approach_max_f": (8.0, 5.0, 15.0), **FAN_HI},
     raw=lambda p: hydronic_on() & (frac("tower_fan_cmd") >= P(p, "tower_fan_hi"))
     & (C("cw_supply_t") - C("web_wb_t") > P(p, "approach_max_f")))
rule("CW-FAN-1", TOWER, "cw_supply_t web_wb_t tower_fan_cmd", HYDRO, 900,
     params={**APPROACH, "excess_beyond_approach_f": (5.0, 2.0, 20.0), **FAN_HI},
     raw=lambda p: hydronic_on() & (frac("tower_fan_cmd") >= P(p, "tower_fan_hi"))
     & (C("cw_supply_t") > C("web_wb_t") + P(p, "cw_approach") + P(p, "excess_beyond_approach_f")))
rule("HP-1", "heatpump", "sat zone_t fan_cmd", "compressor_status fan_status", 600,
     params={"min_sat": (85.0, 70.0, 110.0), "zone_cold": (69.0, 60.0, 72.0)},
     raw=lambda p: F.coalesce(C("compressor_status") > num(0.05), C("fan_status") > num(0.05),
                              frac("fan_cmd") > num(0.05), F.lit(True))
     & (frac("fan_cmd") >= num(0.05)) & (C("zone_t") < P(p, "zone_cold")) & (C("sat") < P(p, "min_sat")))
REQUEST = {"request_lo": (1.0, 0.0, 10.0)}
rule("TRIM-3", "boiler", "hw_supply_t", HYDRO + " hw_reset_request_sum", 1800,
     params={"hwst_hi": (160.0, 120.0, 200.0), **REQUEST},
     raw=lambda p: hydronic_on() & (C("hw_supply_t") > P(p, "hwst_hi"))
     & (F.coalesce(C("hw_reset_request_sum"), num(0)) <= P(p, "request_lo")))
rule("TRIM-4", CHILLER, "chw_supply_t", HYDRO + " chw_reset_request_sum", 1800,
     params={"chw_lo": (45.0, 35.0, 55.0), **REQUEST},
     raw=lambda p: hydronic_on() & (C("chw_supply_t") < P(p, "chw_lo"))
     & (F.coalesce(C("chw_reset_request_sum"), num(0)) <= P(p, "request_lo")))


def on_bit() -> Column:
    return F.coalesce(C("fan_status") > num(0.05), C("pump_status") > num(0.05),
                      C("chiller_status") > num(0.05), frac("fan_cmd") >= num(0.05), F.lit(False))


# The share of on-samples is a whole-series condition; it is applied to the summed result,
# or joined back for the per-row form, instead of being broadcast over every row by a window.
rule("SCHED-247", "ahu vav chiller boiler heatpump", "", "fan_status pump_status chiller_status fan_cmd", 3600,
     params={"always_on_pct": (0.95, 0.8, 1.0)}, raw=lambda p: on_bit(),
     keep=lambda p: F.avg(on_bit().cast("double")) >= P(p, "always_on_pct"))
