"""Run rules over a wide history table (A-5, A-6, A-10 to A-12, A-14 to A-18).

All rules share one scan, one exchange and one sort: each rule contributes a raw flag and a
running "last clear row" to the same window, and the confirmed flags are summed per
equipment. The wide sums are unpivoted only after aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import any_of, frac, holds, num
from thermaline.functions.roles import ensure_roles
from thermaline.functions.scalars import with_scalars
from thermaline.operators.confirm import streak
from thermaline.operators.rules import RULES, Rule
from thermaline.operators.series import block_window, core_rows, split_series

C = F.col
PASS, FAULT, ERROR = "PASS", "FAULT", "ERROR"
MISSING, OFF = "SKIPPED_MISSING_ROLES", "SKIPPED_EQUIPMENT_OFF"
NOT_APPLICABLE = "NOT_APPLICABLE_EQUIPMENT_TYPE"


# --- parameters ------------------------------------------------------------------------------
def effective_params(rule_id: str, *layers: Mapping | None, poll: float = 300.0) -> dict:
    """A-15: rule defaults overridden by the layers in order (global, building, equipment,
    session); values are clamped to the parameter's range, unknown names are an error."""
    merged: dict = {}
    for layer in layers:
        merged.update((layer or {}).get(rule_id, {}))
    return RULES[rule_id].settings(poll, **merged)


def attach_tuning(history: DataFrame, tuning: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """A-15 as data: `tuning` has building_id, equipment_id, rule_id, name, value. A row with both ids holds for that equipment, one
    with the building only for all of it, one without ids everywhere; the closest layer wins, the rule's default fills the rest, and
    values are clamped to the parameter's range.

    Returns the history with a column per tuned parameter and, by rule, its parameters as (column, largest value). The join is on the
    series key; the parameter table has one row per series. Names are read from the table, one row per parameter."""
    known = {r: RULES[r].settings() for r in RULES}
    rows = tuning.groupBy("rule_id", "name").agg(F.max("value").alias("most")).collect()
    out: dict[str, dict] = {}
    for r in rows:
        if r["name"] not in known.get(r["rule_id"], {}) or r["name"] == "poll":
            raise KeyError(f"{r['rule_id']}: unknown parameter {r['name']}")
    pick = lambda r: F.max(F.when((C("rule_id") == r["rule_id"]) & (C("name") == r["name"]), C("value")))
    cols = [f"_p{i}" for i in range(len(rows))]
    layer = lambda where, keys, tag: tuning.where(where).groupBy(*keys).agg(*[pick(r).alias(c + tag) for r, c in zip(rows, cols)])
    own, site = C(EQ).isNotNull() & C(SITE).isNotNull(), C(EQ).isNull() & C(SITE).isNotNull()
    everywhere = tuning.where(C(EQ).isNull() & C(SITE).isNull()).agg(*[pick(r).alias(c + "g") for r, c in zip(rows, cols)])
    series = history.select(*ID).distinct().join(layer(own, ID, "e"), list(ID), "left").join(layer(site, [SITE], "s"), SITE, "left")
    series = with_scalars(series, everywhere)
    for r, c in zip(rows, cols):
        rule, name = RULES[r["rule_id"]], r["name"]
        lo, hi = rule.params[name][1:] if name in rule.params else (0.0, float("inf"))
        value = F.coalesce(C(c + "e"), C(c + "s"), C(c + "g"), num(known[rule.id][name]))
        series = series.withColumn(c, F.greatest(num(lo), F.least(num(hi), value)))
        out.setdefault(rule.id, {})[name] = (C(c), min(max(float(r["most"]), known[rule.id][name], lo), hi))
    return history.join(series.select(*ID, *cols), list(ID)), out


# --- equipment kinds -------------------------------------------------------------------------
# Id patterns, first hit wins.
KIND_PATTERNS = [
    ("weather", r"WEATHER|METEO|^OAT"), ("vav", r"VAV|FPB|TERMINAL"), ("zone", r"ZONE"),
    ("ahu", r"AHU|RTU|DOAS|MAU"), ("cooling_tower", r"TOWER|^CT[_-]?\d"), ("chiller", r"CHILLER|CHW|^CH[_-]?\d"),
    ("boiler", r"BOILER|HHW|^BLR"), ("heatpump", r"HEAT ?PUMP|^HP[_-]?\d|WSHP"), ("meter", r"METER"),
]


def equipment_kind(eq: str = EQ) -> Column:
    """A-18: kind from the equipment id; 'unknown' when nothing matches."""
    up, out = F.upper(C(eq)), None
    for kind, pattern in KIND_PATTERNS:
        cond = up.rlike(pattern)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out.otherwise(F.lit("unknown"))


# --- weather ---------------------------------------------------------------------------------
WX = ("oa_t", "web_oa_t", "web_oa_dp")


def weather_by_time(weather: DataFrame) -> DataFrame:
    """J-10: one row per building and timestamp, MAX of each reading."""
    w = ensure_roles(weather, WX)
    return w.groupBy(SITE, TS).agg(*[F.max(r).alias(f"wx_{r}") for r in WX])


def attach_weather(history: DataFrame, weather: DataFrame | None) -> DataFrame:
    """Left join on the timestamp. No broadcast hint: the table grows with the time span, so
    the planner decides from its measured size."""
    if weather is None:
        return ensure_roles(history, []).withColumns({f"wx_{r}": F.lit(None).cast("double") for r in WX})
    return history.join(weather_by_time(weather), [SITE, TS], "left")


# --- annotation ------------------------------------------------------------------------------
def missing_roles(rule: Rule, columns: Iterable[str], weather: DataFrame | None = None) -> list[str]:
    """Required roles without a column. A rule that reads the weather table also needs the readings as its own columns where there is no table."""
    have = {c.lower() for c in columns}
    return [r for r in (*rule.required, *(own_weather(rule) if weather is None else ())) if r not in have]


def own_weather(rule: Rule) -> list[str]:
    """The columns in which a rule that reads the weather table finds the readings of equipment that has its own."""
    return [r for r in rule.optional if r in WX] if rule.weather else []


def _no_weather(rule: Rule, weather: DataFrame | None) -> Column | None:
    """Aggregate: without a weather table, the equipment has no reading of its own either. None where that can't be."""
    own = own_weather(rule) if weather is None else []
    return F.least(*[F.count(r) for r in own], F.lit(2**62)) == 0 if own else None


def _needed(rules) -> list[str]:
    return list(dict.fromkeys(r for d in rules for r in (*d.required, *d.optional)))


@dataclass
class Job:
    rule: Rule
    p: dict
    tuned: dict | None = None  # name -> (column, largest value)

    @property
    def predicate_params(self) -> dict:
        """Parameters of the raw predicate. Sizes of windows are numbers: the predicate's columns can differ by equipment."""
        return self.p | {k: c for k, (c, _) in (self.tuned or {}).items()}

    @property
    def rows(self) -> Column:
        """Rows to confirm."""
        if "confirm_seconds" not in (self.tuned or {}):
            return F.lit(self.rule.confirm_rows(self.p))
        n = F.greatest(F.lit(1), F.ceil(self.tuned["confirm_seconds"][0] / num(max(self.p["poll"], 1.0))))
        return n + F.lit(self.rule.extra_rows(self.p))

    @property
    def look_back(self) -> int:
        most = self.p | {k: m for k, (_, m) in (self.tuned or {}).items()}
        return max(self.rule.lookback(self.p) + self.rule.confirm_rows(x) for x in (self.p, most))

    @property
    def raw(self):
        return f"r{self.rule.tag}"

    @property
    def done(self):
        return f"c{self.rule.tag}"


def annotate(history: DataFrame, jobs: list[Job], weather: DataFrame | None = None, *,
             tiebreak=(), gates: Mapping[str, Column] | None = None,
             before_extra: int = 0, gate_steps=None, rows: int | None = None, **kw) -> DataFrame:
    """Core rows with a raw and a confirmed flag per rule. `rows`: the number of rows of `history`, counted here if not given."""
    rows = history.count() if rows is None else rows
    df = ensure_roles(history, _needed([j.rule for j in jobs]))
    if any(j.rule.weather for j in jobs):
        df = attach_weather(df, weather)
    back = max([j.look_back for j in jobs], default=1)
    s = split_series(df, ID, TS, before=back + before_extra + 2, rows=rows, **kw)
    # Equal stamps are ordered by their readings, so the answer doesn't depend on how rows arrive.
    w = block_window(ID, TS, tiebreak or _needed([j.rule for j in jobs]))
    levels: list[dict] = [{"_rn": F.row_number().over(w)}]
    for j in jobs:
        for i, step in enumerate(j.rule.steps(j.p, w) if j.rule.steps else []):
            while len(levels) <= i:
                levels.append({})
            levels[i].update(step)
    for level in levels:
        s = s.withColumns(level)
    if gate_steps:
        for level in gate_steps(w):
            s = s.withColumns(level)
    gates = gates or {}
    raws = {}
    for j in jobs:
        raw = j.rule.raw(j.predicate_params)
        if j.rule.where is not None and not j.rule.drops_rows:
            raw = raw & j.rule.where()
        if j.rule.id in gates:
            raw = raw & gates[j.rule.id]
        raws[j.raw] = holds(raw)
    s = s.withColumns(raws)
    s = s.withColumns({j.done: streak(C(j.raw), C("_rn"), w) >= j.rows for j in jobs})
    return core_rows(s)


def _job(rule_id: str, poll: float, params: Mapping | None) -> Job:
    return Job(RULES[rule_id], RULES[rule_id].settings(poll, **dict(params or {})))


# --- single rule -----------------------------------------------------------------------------
def run_rule(history: DataFrame, rule_id: str, *, weather: DataFrame | None = None, poll: float = 300.0,
             params: Mapping | None = None, tiebreak=(), **kw) -> DataFrame:
    """One rule's own result columns per equipment (A-5). A missing required role gives one
    SKIPPED_MISSING_ROLES row per equipment instead of an error."""
    j = _job(rule_id, poll, params)
    lacking = missing_roles(j.rule, history.columns, weather)
    if lacking:
        return (history.select(*ID).distinct()
                .select(*ID, F.lit(MISSING).alias("status"), F.lit(", ".join(lacking)).alias("missing")))
    df = history
    if j.rule.where is not None:
        df = df.where(j.rule.where())
    if j.rule.aggs:
        return df.groupBy(*ID).agg(*[c.alias(n) for n, c in j.rule.aggs(j.p).items()])
    a = annotate(df, [j], weather, tiebreak=tiebreak, **kw)
    n = F.sum(C(j.done).cast("int"))
    if (none := _no_weather(j.rule, weather)) is not None:
        n = F.when(~none, n)
    out = [fault_hours(n, j.p, j.rule).alias("fault_hours")]
    if j.rule.pct:
        out.append((num(100) * n / F.count(F.lit(1))).alias("fault_pct"))
    if none is not None:
        out.append(F.when(none, MISSING).when(n > 0, FAULT).otherwise(PASS).alias("status"))
    if rule_id == "CHW-NOLOAD-1":
        seen = F.max(C("building_zone_load_satisfied").isNotNull() | C("building_ahu_load_satisfied").isNotNull())
        out.append(F.when(~seen, MISSING).when(n > 0, FAULT).otherwise(PASS).alias("status"))
    return a.groupBy(*ID).agg(*out)


def fault_hours(n: Column, p: dict, rule: Rule) -> Column:
    if rule.keep is not None:
        n = F.when(holds(rule.keep(p)), n).otherwise(F.lit(0))
    return n * num(p["poll"]) / num(3600)


def confirmed_series(history: DataFrame, rule_id: str, *, weather: DataFrame | None = None,
                     poll: float = 300.0, params: Mapping | None = None, columns=(), **kw) -> DataFrame:
    """A-6: raw and confirmed flag per timestamp, with any sensor columns asked for (B-41)."""
    j = _job(rule_id, poll, params)
    df = history.where(j.rule.where()) if j.rule.where is not None else history
    a = annotate(df, [j], weather, **kw)
    done = C(j.done)
    if j.rule.keep is not None:
        share = df.groupBy(*ID).agg(holds(j.rule.keep(j.p)).alias("_keep"))
        a = a.join(share, list(ID))
        done = done & C("_keep")
    return a.select(*ID, TS, *columns, C(j.raw).alias("raw_fault"), done.alias("confirmed"))


def rule_series(history: DataFrame, rule_id: str, **kw) -> DataFrame:
    """B-41: the rule's sensor columns next to its flags."""
    r = RULES[rule_id]
    cols = [c for c in (*r.required, *r.optional) if c in history.columns]
    return confirmed_series(history, rule_id, columns=list(dict.fromkeys(cols)), **kw)


# --- many rules ------------------------------------------------------------------------------
def confirmable(rule_ids=None) -> list[str]:
    return [i for i in (rule_ids or RULES) if RULES[i].aggs is None]


def run_rules(history: DataFrame, rule_ids=None, *, weather: DataFrame | None = None, poll: float = 300.0,
              params: Mapping[str, Mapping] | None = None, tiebreak=(), counted: Column | None = None, tuning: DataFrame | None = None, **kw) -> DataFrame:
    """A-16: every rule in one pass, as rows (building_id, equipment_id, rule_id, status, fault_hours,
    fault_samples, samples). Only rows for which `counted` holds count; the others lead in.
    `tuning`: parameters by building and equipment, see `attach_tuning`; those that size a window keep one value. Rules whose required roles are absent yield skip rows. A rule
    that drops rows inside a series needs its own ordering and gets its own pass."""
    params, rows = params or {}, history.count()
    jobs = [_job(i, poll, params.get(i)) for i in confirmable(rule_ids)]
    if tuning is not None:
        history, tuned = attach_tuning(history, tuning)
        for j in jobs:
            j.tuned = tuned.get(j.rule.id)
    ready = [j for j in jobs if not missing_roles(j.rule, history.columns, weather)]
    skipped = [j for j in jobs if missing_roles(j.rule, history.columns, weather)]
    passes = [[j for j in ready if not j.rule.drops_rows]] + [[j] for j in ready if j.rule.drops_rows]
    parts = []
    for group in filter(None, passes):
        df = history
        if group[0].rule.drops_rows:
            df = df.where(group[0].rule.where())
        parts.append(_run_pass(df, group, weather, tiebreak, poll, counted, rows=rows, **kw))
    if skipped:
        ids = F.array(*[F.lit(j.rule.id) for j in skipped])
        parts.append(history.select(*ID).distinct().select(
            *ID, F.explode(ids).alias("rule_id"), F.lit(MISSING).alias("status"),
            F.lit(None).cast("double").alias("fault_hours"),
            F.lit(None).cast("long").alias("fault_samples"), F.lit(None).cast("long").alias("samples")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lead_in_rows(rule_ids=None, *, poll: float = 300.0, params: Mapping[str, Mapping] | None = None) -> int:
    """Rows that the rules may look back on, their confirmation included."""
    jobs = [_job(i, poll, (params or {}).get(i)) for i in confirmable(rule_ids)]
    return 2 + max((j.rule.lookback(j.p) + j.rule.confirm_rows(j.p) for j in jobs), default=0)


def _run_pass(df, jobs, weather, tiebreak, poll, counted=None, **kw) -> DataFrame:
    a = annotate(df, jobs, weather, tiebreak=tiebreak, **kw)
    a = a if counted is None else a.where(counted)
    aggs = []
    for j in jobs:
        n = F.sum(C(j.done).cast("long"))
        if j.rule.keep is not None:
            n = F.when(holds(j.rule.keep(j.p)), n).otherwise(F.lit(0).cast("long"))
        if (none := _no_weather(j.rule, weather)) is not None:
            n = F.when(none, F.lit(-1).cast("long")).otherwise(n)
        if j.rule.where is not None and not j.rule.drops_rows:
            n = F.when(F.max(holds(j.rule.where())), n)
        aggs.append(n.alias(j.rule.id))
    known = F.when(C("fault_samples") >= 0, C("fault_samples"))
    wide = a.groupBy(*ID).agg(F.count(F.lit(1)).alias("samples"), *aggs)
    return (wide.unpivot([*ID, "samples"], [f"`{j.rule.id}`" for j in jobs], "rule_id", "fault_samples")
                .where(C("fault_samples").isNotNull())
                .select(*ID, C("rule_id"),
                        F.when(C("fault_samples") < 0, MISSING).when(C("fault_samples") > 0, FAULT).otherwise(PASS).alias("status"),
                        (known * num(poll) / num(3600)).alias("fault_hours"), known.alias("fault_samples"), F.when(known.isNotNull(), C("samples")).alias("samples")))


# --- operational gates (A-10, A-11) ----------------------------------------------------------
# Gate kind and startup delay in seconds per rule.
GATES: dict[str, tuple[str, int]] = {
    "SV-RANGE": ("equipment_energized", 0), "SV-FLATLINE": ("conditional", 0),
    "SV-SPIKE": ("equipment_energized", 0), "PID-HUNT-1": ("control_loop", 300),
    "FC1": ("fan_running", 300), "FC4": ("control_loop", 300),
    **{r: ("fan_running", 600) for r in (
        "FC2", "FC3", "FC5", "FC6", "FC7", "FC8", "FC9", "FC10", "FC11", "FC12", "FC13-SAT-HIGH",
        "FC14", "FC15", "AHU-SATDEV", "ECON-1", "ECON-3", "ECON-4", "ECON-5", "ECON-6", "ECON-7",
        "VAV-REHEAT", "VAV-AHU-LEAVE", "OA-1")},
    **{r: ("fan_running", 300) for r in (
        "AHU-SIMUL", "ECON-2", "VAV-3", "VAV-5", "VAV-6", "VAV-7", "TRIM-1", "RESET-1")},
    "AHU-DUCTHI": ("conditional", 0), "VAV-1": ("conditional", 0), "VAV-4": ("control_loop", 300),
    "DMP-1": ("conditional", 300), "VLV-1": ("conditional", 300), "HP-1": ("compressor", 600),
    "CHW-1": ("hydronic_flow", 900),
    **{r: ("hydronic_flow", 600) for r in ("CHW-3", "CW-OPT-1", "CW-APR-1", "CW-FAN-1", "TRIM-3", "TRIM-4")},
    **{r: ("hydronic_flow", 300) for r in ("CHW-2", "CHW-4")},
}
# Proof signals in order of trust.
FAN_PROOF, FAN_COMMAND = ("fan_status",), ("fan_cmd",)
PUMP_PROOF = ("pump_status", "chw_pump_status", "chiller_status", "compressor_status",
              "chiller_current", "chiller_amps", "chiller_power", "chw_flow")
PUMP_COMMAND = ("chw_pump_cmd",)
COMPRESSOR_PROOF = ("compressor_status", "fan_status", "fan_cmd")
GATE_ROLES = tuple(dict.fromkeys((*FAN_PROOF, *FAN_COMMAND, *PUMP_PROOF, *PUMP_COMMAND, *COMPRESSOR_PROOF,
                                  "zone_flow", "loop_enabled", "occ_mode", "oa_damper_pct", "duct_static")))


def signal_on(role: str) -> Column:
    """Any signal as on/off: values above 1.5 are percentages, on means above 0.05."""
    return F.when(C(role) > num(1.5), C(role) / num(100)).otherwise(C(role)) > num(0.05)


def _has(role: str) -> Column:
    return C(f"_has_{role}")


def _first_mapped(roles, otherwise: Column | None) -> Column:
    """The first signal that has data anywhere in the equipment's history decides every row."""
    out = None
    for r in roles:
        v = holds(signal_on(r))
        out = F.when(_has(r), v) if out is None else out.when(_has(r), v)
    return out if otherwise is None else out.otherwise(otherwise)


def fan_gate() -> Column:
    return F.coalesce(_first_mapped(FAN_PROOF + FAN_COMMAND, None),
                      F.when(_has("zone_flow"), holds(C("zone_flow") > num(50))))


def gate(rule_id: str, p: Mapping | None = None) -> Column | None:
    """Active mask of a rule before any startup delay; None for rules without a gate. A NULL mask
    means no proof signal is mapped: the equipment is not gated at all, but for water flow,
    which must be proven."""
    kind = GATES.get(rule_id, ("always", 0))[0]
    pump = _first_mapped(PUMP_PROOF + PUMP_COMMAND, None)
    fan = fan_gate()
    if kind == "always":
        return None
    if kind == "fan_running":
        return fan
    if kind == "hydronic_flow":
        return F.coalesce(pump, F.lit(False))
    if kind == "compressor":
        return _first_mapped(COMPRESSOR_PROOF, None)
    if kind == "control_loop":
        loop = F.when(_has("loop_enabled"), holds(signal_on("loop_enabled"))).otherwise(True)
        return F.when(fan.isNotNull(), fan & loop)
    if kind == "equipment_energized" or rule_id == "SV-FLATLINE":
        return F.coalesce(fan, pump, _first_mapped(COMPRESSOR_PROOF, None))
    if rule_id == "VAV-1":
        occ = F.lower("occ_mode").isin("occupied", "1", "true", "on")
        return F.when(_has("occ_mode"), holds(occ) & F.coalesce(fan, F.lit(True))).otherwise(fan)
    if rule_id == "DMP-1":
        return F.when(_has("oa_damper_pct"), F.coalesce(fan, F.lit(True)) | holds(frac("oa_damper_pct") > num(0.01))).otherwise(fan)
    if rule_id == "AHU-DUCTHI":
        live = holds(F.abs(C("duct_static")) > num((p or {}).get("pressure_on_min", 0.2)))
        return F.when(_has("duct_static"), F.coalesce(fan, F.lit(False)) | live).otherwise(fan)
    return fan


def role_presence(history: DataFrame, roles) -> DataFrame:
    """Per equipment: whether each role has any reading, and its share of samples."""
    return history.groupBy(*ID).agg(
        *[(F.count(r) > 0).alias(f"_has_{r}") for r in roles],
        *[(F.count(r) / F.count(F.lit(1))).alias(f"_cov_{r}") for r in roles])


def run_batch(history: DataFrame, rule_ids=None, *, weather: DataFrame | None = None, poll: float = 300.0,
              params: Mapping[str, Mapping] | None = None, gates: bool = True, min_coverage: float = 0.5, min_active_pct: float = 5.0,
              kind: Column | None = None, tiebreak=(), **kw) -> DataFrame:
    """A-17: status per (equipment, rule) from applicability, role coverage, gates and faults.

    not applicable -> missing roles -> no proof -> equipment off -> FAULT / PASS. Rows where
    a required role is covered below `min_coverage` are flagged, not skipped; equipment active for
    under `min_active_pct` of its samples is off.
    """
    from thermaline.operators.confirm import confirm_row_count
    params = params or {}
    jobs = [_job(i, poll, params.get(i)) for i in confirmable(rule_ids)]
    roles = list(dict.fromkeys([*_needed([j.rule for j in jobs]), *GATE_ROLES]))
    df = ensure_roles(history, roles)
    df = df.join(role_presence(df, roles), list(ID))
    masks, active, delays = {}, {}, {}
    for j in jobs:
        g = gate(j.rule.id, j.p) if gates else None
        if g is not None:
            n = confirm_row_count(GATES[j.rule.id][1], poll) if GATES[j.rule.id][1] else 1
            masks[j.rule.id], delays[j.rule.id] = g, n
            active[j.rule.id] = C(f"a{j.rule.tag}")

    def gate_steps(w):
        return [{f"g{RULES[i].tag}": g for i, g in masks.items()},
                {f"a{RULES[i].tag}": C(f"g{RULES[i].tag}").isNull() | (streak(holds(C(f"g{RULES[i].tag}")), C("_rn"), w) >= F.lit(delays[i]))
                 for i in masks}]

    a = annotate(df, jobs, weather, tiebreak=tiebreak, gates=active, gate_steps=gate_steps,
                 before_extra=max(delays.values(), default=0), rows=history.count(), **kw)
    seen = [f"_{x}_{r}" for r in roles for x in ("has", "cov")]
    aggs = [F.first(c).alias(c) for c in seen]
    for j in jobs:
        t = j.rule.tag
        n = F.sum(C(j.done).cast("long"))
        if j.rule.keep is not None:
            n = F.when(holds(j.rule.keep(j.p)), n).otherwise(F.lit(0).cast("long"))
        aggs.append(n.alias(f"n{t}"))
        aggs.append((F.sum(C(f"a{t}").cast("long")) if j.rule.id in masks
                     else F.count(F.lit(1))).alias(f"t{t}"))
    wide = a.groupBy(*ID).agg(F.count(F.lit(1)).alias("samples"), *aggs).withColumn(
        "kind", equipment_kind() if kind is None else kind)

    def verdict(j: Job) -> Column:
        r, t = j.rule, j.rule.tag
        cov = [C(f"_cov_{x}") for x in r.required]
        out = F.when((C("kind") != "unknown") & ~C("kind").isin(list(r.kinds)), NOT_APPLICABLE)
        if cov:
            out = out.when(F.least(*cov, num(1)) <= num(0), MISSING)
        if own := (own_weather(r) if weather is None else []):
            out = out.when(any_of(~_has(x) for x in own), MISSING)
        if GATES.get(r.id, ("", 0))[0] == "hydronic_flow" and gates:
            proof = [_has(x) for x in PUMP_PROOF + PUMP_COMMAND]
            out = out.when(~F.greatest(*proof), MISSING)
        if r.id in masks:
            out = out.when(num(100) * C(f"t{t}") < num(min_active_pct) * C("samples"), OFF)
        out = out.when(C(f"n{t}") > 0, FAULT).otherwise(PASS)
        low = F.least(*cov, num(1)) < num(min_coverage) if cov else F.lit(False)
        return F.struct(F.lit(r.id).alias("rule_id"), out.alias("status"), C(f"n{t}").alias("fault_samples"),
                        C(f"t{t}").alias("active_samples"), low.alias("quality_below_minimum"))

    rows = wide.select(*ID, "kind", "samples", F.explode(F.array(*[verdict(j) for j in jobs])).alias("v"))
    ran = C("v.status").isin(FAULT, PASS)
    return rows.select(
        *ID, "kind", C("v.rule_id").alias("rule_id"), C("v.status").alias("status"),
        F.when(ran, C("v.fault_samples") * num(poll) / num(3600)).otherwise(num(0)).alias("fault_hours"),
        F.when(ran, F.coalesce(num(100) * F.try_divide(C("v.fault_samples"), C("v.active_samples")), num(0)))
         .otherwise(num(0)).alias("fault_pct"),
        C("v.active_samples").alias("active_samples"), C("v.quality_below_minimum").alias("quality_below_minimum"))


def mode_stable(history: DataFrame, delay_minutes: float, *, poll: float = 300.0,
                params: Mapping | None = None, **kw) -> DataFrame:
    """A-12: operating state 0-4, and false for ceil(delay / poll) rows from a change on."""
    p = {"fan_on_min": 0.01, "econ_min_pos": 0.05, "clg_on_min": 0.01, "htg_on_min": 0.01, **(params or {})}
    from thermaline.operators.series import with_series_columns

    def z(r):
        return F.coalesce(frac(r), num(0))

    fan = z("fan_cmd") > num(p["fan_on_min"])
    htg, clg = z("htg_valve_pct") > num(p["htg_on_min"]), z("clg_valve_pct") > num(p["clg_on_min"])
    econ = z("oa_damper_pct") > num(p["econ_min_pos"])
    state = (F.when(fan & htg & ~clg, 1).when(fan & ~htg & ~clg & econ, 2)
              .when(fan & ~htg & clg & econ, 3).when(fan & ~htg & clg & ~econ, 4).otherwise(0))
    n = max(1, -int(-delay_minutes * 60.0 // poll))
    df = ensure_roles(history, ["fan_cmd", "htg_valve_pct", "clg_valve_pct", "oa_damper_pct"])
    if delay_minutes <= 0:
        return df.withColumns({"op_state": state, "mode_stable": F.lit(True)})
    return with_series_columns(
        df.withColumn("op_state", state),
        lambda w: [{"_chg": holds(C("op_state") != F.lag("op_state").over(w))},
                   {"mode_stable": ~F.max("_chg").over(w.rowsBetween(1 - n, 0))}],
        ID, TS, before=n + 1, **kw).drop("_chg")


# --- user rules (A-21, A-22) -----------------------------------------------------------------
OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
       "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def simple_rule(history: DataFrame, role: str, op: str, value: float) -> DataFrame:
    return history.withColumn("fault_raw", holds(OPS[op](C(role), num(value))))


def custom_rule(history: DataFrame, predicate, *, params: Mapping[str, float] | None = None,
                confirm_rows: int = 1, **kw) -> DataFrame:
    """A user predicate, as SQL text with ${param} marks or as a Column, then confirmation."""
    from string import Template

    from thermaline.operators.confirm import confirm_rows as confirm
    if isinstance(predicate, str):
        marks = {k: f"CAST({float(v)!r} AS DOUBLE)" for k, v in (params or {}).items()}
        predicate = F.expr(Template(predicate).substitute(marks))
    return confirm(history, predicate, confirm_rows, **kw)


def custom_mask(history: DataFrame, fn, columns, *, before: int, target_rows: int | None = None) -> DataFrame:
    """A user Python mask: fn(pandas frame ordered by time) -> booleans. It sees one block of
    a series plus the `before` earlier rows that the mask looks back on."""
    s = split_series(history.select(*ID, TS, *columns), ID, TS, before=before, target_rows=target_rows)

    def apply(pdf):
        pdf = pdf.sort_values(TS)
        pdf["fault_raw"] = [bool(v) for v in fn(pdf)]
        return pdf.loc[pdf["_core"], [*ID, TS, "fault_raw"]]

    return s.groupBy(*ID, "_block").applyInPandas(
        apply, f"{SITE} string, {EQ} string, {TS} timestamp, fault_raw boolean")


def rolling_zscore(history: DataFrame, role: str, *, rows: int = 12, limit: float = 3.0, **kw) -> DataFrame:
    """V-6: distance from the rolling mean in rolling standard deviations."""
    from thermaline.operators.series import with_series_columns

    def make(w):
        roll = w.rowsBetween(1 - rows, 0)
        return {"zscore": F.try_divide(C(role) - F.avg(role).over(roll), F.stddev_samp(role).over(roll))}

    return with_series_columns(history, make, ID, TS, before=rows, **kw).withColumn(
        "fault_raw", holds(F.abs("zscore") > num(limit)))


