"""Fault lifecycle and engineering findings (H-1 to H-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import any_of, holds, num
from thermaline.functions.scalars import with_scalars
from thermaline.operators.confirm import runs
from thermaline.operators.rules import RULES
from thermaline.operators.runner import FAULT, equipment_kind

C = F.col


# --- lifecycle -------------------------------------------------------------------------------
def fault_records(results: DataFrame, clears: DataFrame | None = None, *, now: Column | None = None) -> DataFrame:
    """H-1/H-13: one record per (equipment, rule) with samples in fault: confirmed when any
    sample was confirmed, raw otherwise. A cleared fault stays hidden until its snooze ends.
    `results`: equipment_id, rule_id, raw_samples, fault_samples, severity, first_seen, last_seen."""
    r = results.where((C("raw_samples") > 0) | (C("fault_samples") > 0)).withColumns({
        "fault_id": F.concat_ws("|", *ID, "rule_id"),
        "status": F.when(C("fault_samples") > 0, "confirmed").otherwise("raw")})
    if clears is None:
        return r
    hidden = clears.where(C("snooze_until") > (F.current_timestamp() if now is None else now)).select("fault_id").distinct()
    return r.join(hidden, "fault_id", "left_anti")


#: A fault's intervals: one row per (fault, episode); `cleared_at` is null while it is open.
LIFECYCLE = ("fault_id STRING, building_id STRING, equipment_id STRING, rule_id STRING, episode INT, status STRING, severity STRING, "
             "opened_at TIMESTAMP, last_seen_at TIMESTAMP, cleared_at TIMESTAMP, cleared_by STRING")


def update_lifecycle(state: DataFrame, results: DataFrame, *, now: Column, clears: DataFrame | None = None) -> DataFrame:
    """H-1/H-13: the interval table after an evaluation at `now`. A fault in the results opens an interval or keeps its open one; a
    fault that was evaluated without samples in fault is cleared (`recovered`), one whose snooze lasts is cleared (`user`) and stays
    closed until the snooze ends. A fault that comes back opens the next episode. Faults that weren't evaluated keep their state, and
    the same evaluation applied twice changes nothing.

    `state`: LIFECYCLE; `results`: as for `fault_records`, one row per evaluated (equipment, rule), those without faults included;
    `clears`: fault_id, snooze_until.
    """
    seen = results.select(F.concat_ws("|", *ID, "rule_id").alias("fault_id"), *[C(c).alias("_" + c) for c in (*ID, "rule_id", "severity")],
                          (F.coalesce("raw_samples", F.lit(0)) > 0).alias("_raw"), (F.coalesce("fault_samples", F.lit(0)) > 0).alias("_sure"))
    if clears is None:
        seen = seen.withColumn("_snoozed", F.lit(False))
    else:
        hidden = clears.where(C("snooze_until") > now).select("fault_id").distinct().withColumn("_hidden", F.lit(True))
        seen = seen.join(hidden, "fault_id", "left").withColumn("_snoozed", C("_hidden").isNotNull()).drop("_hidden")
    past = state.groupBy("fault_id").agg(F.max("episode").alias("_episodes"), F.max(C("cleared_at").isNull()).alias("_open"))
    seen = seen.withColumns({"_active": C("_raw") | C("_sure"), "_status": F.when(C("_sure"), "confirmed").otherwise("raw")})
    kept = state.join(seen, "fault_id", "left")
    live = C("cleared_at").isNull() & C("_active").isNotNull()
    stays, ends = live & C("_active") & ~C("_snoozed"), live & (~C("_active") | C("_snoozed"))
    kept = kept.select("fault_id", *ID, "rule_id", "episode",
                       F.when(stays, C("_status")).when(ends, "cleared").otherwise(C("status")).alias("status"),
                       F.when(stays, C("_severity")).otherwise(C("severity")).alias("severity"), "opened_at",
                       F.when(stays, now).otherwise(C("last_seen_at")).alias("last_seen_at"),
                       F.when(ends, now).otherwise(C("cleared_at")).alias("cleared_at"),
                       F.when(ends & C("_snoozed"), "user").when(ends, "recovered").otherwise(C("cleared_by")).alias("cleared_by"))
    fresh = seen.where(C("_active") & ~C("_snoozed")).join(past, "fault_id", "left").where(~F.coalesce("_open", F.lit(False)))
    fresh = fresh.select("fault_id", *[C("_" + c).alias(c) for c in (*ID, "rule_id")], (F.coalesce("_episodes", F.lit(0)) + 1).cast("int").alias("episode"),
                         C("_status").alias("status"), C("_severity").alias("severity"), now.alias("opened_at"), now.alias("last_seen_at"),
                         F.lit(None).cast("timestamp").alias("cleared_at"), F.lit(None).cast("string").alias("cleared_by"))
    return kept.unionByName(fresh)


def fault_summary(records: DataFrame) -> DataFrame:
    n = lambda *s: F.count(F.when(C("status").isin(*s), 1))
    return records.groupBy(SITE).agg(n("raw").alias("raw_count"), n("confirmed").alias("confirmed_count"), n("cleared").alias("cleared_count"),
                       n("raw", "confirmed").alias("active_count"), F.count(F.lit(1)).alias("total_count"))


def fault_trend(flags: DataFrame, raw: str = "raw_fault") -> DataFrame:
    """H-2: raw fault samples per day."""
    return (flags.where(C(raw)).groupBy(SITE, F.date_format(TS, "yyyy-MM-dd").alias("day"))
                 .agg(F.count(F.lit(1)).alias("raw_fault_samples")))


def top_faulted(records: DataFrame, *, k: int | None = None) -> DataFrame:
    """H-3: equipment by open faults; the first k if asked for."""
    n = records.where(C("status") != "cleared").groupBy(*ID).agg(F.count(F.lit(1)).alias("fault_count"))
    n = n.orderBy(F.desc("fault_count"), *ID)
    return n if k is None else n.limit(k)


def fault_families(records: DataFrame) -> DataFrame:
    """H-4: open faults per rule with the worst severity as a traffic light."""
    rank = F.when(C("severity") == "critical", 3).when(C("severity") == "warning", 2).otherwise(1)
    g = records.where(C("status") != "cleared").groupBy(SITE, C("rule_id").alias("family")).agg(
        F.count(F.lit(1)).alias("fault_count"), F.max(rank).alias("_w"), F.count_distinct(EQ).alias("equipment_count"))
    return g.select(SITE, "family", "fault_count", "equipment_count",
                    F.when(C("_w") == 3, "critical").when(C("_w") == 2, "warning").otherwise("info").alias("worst"),
                    F.when(C("_w") == 3, "red").when(C("_w") == 2, "yellow").otherwise("green").alias("traffic"))


def stats_in_and_out_of_fault(flags: DataFrame, role: str, *, flag: str = "confirmed", keys=ID) -> DataFrame:
    """H-5."""
    bad, ok = F.when(C(flag), C(role)), F.when(~C(flag), C(role))
    return flags.groupBy(*keys).agg(
        F.count(role).alias("total_samples"), F.count(bad).alias("fault_samples"), F.avg(bad).alias("avg_fault"),
        F.avg(ok).alias("avg_normal"), F.min(bad).alias("min_fault"), F.max(bad).alias("max_fault"))


def sparse_intervals(flags: DataFrame, flag: str = "confirmed", **kw) -> DataFrame:
    """H-6: one row per run of a flag."""
    return runs(flags, C(flag), **kw)


def worst_fault_day(flags: DataFrame, flag: str = "confirmed", *, keys=ID) -> DataFrame:
    """H-7: the day with most fault samples, the earliest on a tie."""
    d = flags.where(C(flag)).groupBy(*keys, F.to_date(TS).alias("day")).agg(F.count(F.lit(1)).alias("samples"))
    return d.groupBy(*keys).agg(F.max_by(F.struct("day", "samples"), F.struct(C("samples"), -F.unix_date("day"))).alias("m")).select(
        *keys, F.date_format("m.day", "yyyy-MM-dd").alias("worst_day"), C("m.samples").alias("samples"))


# --- findings --------------------------------------------------------------------------------
DUCT_STATIC_RULES = ["AHU-DUCTHI", "FC1", "FAN-OFF-STATIC"]
FLOW_FAMILY = ["VAV-4", "VAV-5", "VAV-7", "SV-RANGE"]


def equipment_system(kind: Column, rule: Column) -> Column:
    """Reporting system of a fault from the equipment kind, else from the rule."""
    return (F.when((kind == "ahu") | rule.startswith("SCHED") | (rule == "FAN-OFF-STATIC"), "AHU")
             .when(kind == "heatpump", "HP").when((kind == "chiller") | rule.startswith("CHW"), "CHW")
             .when((kind == "boiler") | rule.startswith("HW"), "HW")
             .when((kind == "vav") | rule.startswith("VAV") | rule.startswith("SV-"), "VAV")
             .otherwise(F.upper(kind)))


def candidates(results: DataFrame) -> DataFrame:
    """H-8: FAULT rows with the number of devices sharing the rule and the terminal fleet size.
    Peer counts are aggregated and joined back, so a rule that fires everywhere is not one
    window partition."""
    f = results.where(C("status") == FAULT)
    peers = f.groupBy(SITE, "rule_id").agg(F.count(F.lit(1)).alias("peer_count"))
    fleet = f.where(F.upper(EQ).startswith("VAV")).groupBy(SITE).agg(F.count_distinct(EQ).alias("_fleet"))
    return (f.join(peers, [SITE, "rule_id"]).join(fleet, SITE, "left")
             .withColumn("fleet_size", F.coalesce("_fleet", F.lit(1).cast("long"))).drop("_fleet")
             .withColumns({"candidate_key": F.concat_ws("|", *ID, "rule_id"),
                           "system": equipment_system(equipment_kind(), C("rule_id"))}))


def assess(cand: DataFrame, *, comfort: DataFrame | None = None, spot: DataFrame | None = None,
           static: DataFrame | None = None) -> DataFrame:
    """H-9: additive score and class of each candidate.

    Context, one row per equipment each: comfort (mean_zone_t, outlier), spot (damper_pct,
    airflow), static (fan_off_p50, fan_on_p50). `cand` may carry missing_count.
    """
    d = cand
    for t, cols in ((comfort, ("mean_zone_t", "outlier")), (spot, ("damper_pct", "airflow")),
                    (static, ("fan_off_p50", "fan_on_p50"))):
        if t is not None:
            d = d.join(t.select(*ID, *cols), list(ID), "left")
        else:
            d = d.withColumns({c: F.lit(None).cast("boolean" if c == "outlier" else "double") for c in cols})
    if "missing_count" not in d.columns:
        d = d.withColumn("missing_count", F.lit(0))
    rule, pct = C("rule_id"), C("fault_pct")
    duct = rule.isin(DUCT_STATIC_RULES)
    related = d.groupBy(*ID).agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(~duct, 1)).alias("_plain"))
    d = d.join(related, list(ID))
    others = F.when(duct, C("_all")).otherwise(C("_plain")) - 1
    # Each stage becomes a column before the next one reads it, which keeps the generated
    # expressions small.
    d = d.withColumns({
        "_near": holds(pct >= num(95)),
        "_common": holds(C("peer_count") >= F.greatest(F.lit(5), F.floor(C("fleet_size") * num(0.4)))),
        "_bias": (rule == "VAV-5") & holds((C("damper_pct") <= num(5)) & (C("airflow") >= num(50))),
        "_absent": (rule == "VAV-5") & holds((C("damper_pct") <= num(5)) & (C("airflow") < num(5))),
        "_static": duct & holds((C("fan_on_p50") > num(0)) & (C("fan_off_p50") >= F.greatest(num(1), num(2) * C("fan_on_p50")))),
        "_cold": holds(C("mean_zone_t") < num(40)), "_dead": rule.startswith("VAV-1") & holds(C("outlier")),
        "_unmapped": C("missing_count") > 0, "_others": others})
    near, common, absent, static_bad = C("_near"), C("_common"), C("_absent"), C("_static")
    d = d.withColumns({
        "_tele": F.when(static_bad | C("_bias"), num(20)).otherwise(num(0)),
        "_corr": F.least(num(15), F.least(num(15), num(5) * C("_others")) + F.when(static_bad, num(10)).otherwise(num(0)))})
    telemetry, corroboration = C("_tele"), C("_corr")
    d = d.withColumn("_chw", near & rule.startswith("CHW") & (telemetry < num(10)))
    points = (num(30) + F.when(C("_chw"), num(5)).otherwise(num(10)) + telemetry + corroboration
              + F.coalesce(F.least(num(10), C("fault_hours") / num(200)), num(0))
              + F.when(absent, num(-20)).otherwise(num(0)) + F.when(near, num(-5)).otherwise(num(0))
              + F.when(common, num(-15)).otherwise(num(0)) + F.when(C("_chw"), num(-10)).otherwise(num(0)))
    d = d.withColumn("_score", F.greatest(num(0), F.least(num(100), points)))
    score = C("_score")
    d = d.withColumn("_grade", F.when(score >= num(80), "STRONGLY_SUPPORTED").when(score >= num(60), "PROBABLE")
                     .when(score >= num(40), "INCONCLUSIVE").when(score >= num(20), "LIKELY_FALSE_POSITIVE").otherwise("DATA_QUALITY"))
    weak = near & (telemetry < num(10)) & (corroboration < num(5))
    early = C("_cold") | C("_dead") | C("_unmapped")
    cls = (F.when(C("_cold") | C("_dead"), "DATA_QUALITY").when(C("_unmapped"), "INCONCLUSIVE")
            .when(weak, F.when(score >= num(40), "INCONCLUSIVE").otherwise("LIKELY_FALSE_POSITIVE"))
            .when(absent & (telemetry <= num(0)), "LIKELY_FALSE_POSITIVE")
            .when(near & (C("_grade") == "STRONGLY_SUPPORTED") & (telemetry < num(15)), "PROBABLE").otherwise(C("_grade")))
    final = F.when(C("_cold"), num(5)).when(C("_dead"), num(15)).when(C("_unmapped"), num(25)).otherwise(score)
    return d.withColumns({"score": F.round(final, 1), "classification": cls,
                          "common_mode": F.when(early, F.lit(False)).otherwise(near | common)}).drop(
        *[c for c in d.columns if c.startswith("_")])


def cluster_key() -> Column:
    rule, eq = C("rule_id"), C(EQ)
    return (F.when(rule == "FAN-OFF-STATIC", F.concat_ws("|", F.lit("static"), SITE, eq))
             .when(C("classification") == "DATA_QUALITY", F.concat_ws("|", F.lit("dq"), SITE, eq, rule))
             .when(C("common_mode") & rule.startswith("VAV"), F.concat_ws("|", F.lit("common"), SITE, rule))
             .when(C("common_mode") & rule.startswith("CHW"), F.concat_ws("|", F.lit("chw"), SITE, rule))
             .when(rule.isin(FLOW_FAMILY), F.concat_ws("|", F.lit("vavflow"), SITE, eq))
             .otherwise(F.concat_ws("|", F.lit("solo"), SITE, eq, rule)))


CLASS_RANK = {"STRONGLY_SUPPORTED": 5, "PROBABLE": 4, "DATA_QUALITY": 3, "INCONCLUSIVE": 2, "LIKELY_FALSE_POSITIVE": 1}


def _rank(c: Column) -> Column:
    out = F.lit(0)
    for name, rank in CLASS_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def clusters(assessed: DataFrame) -> DataFrame:
    """H-10: one finding per cluster with the score and class of its best member. Members are
    counted, not collected: an epidemic may cover the whole fleet."""
    a = assessed.where(~C("classification").isin("LIKELY_FALSE_POSITIVE", "NOT_ACTIONABLE")).withColumn("cluster", cluster_key())
    best = F.struct("score", _rank(C("classification")), F.lit(0))
    g = a.groupBy(SITE, "cluster").agg(
        F.max("score").alias("score"), F.max_by("classification", best).alias("classification"),
        F.count(F.lit(1)).alias("members"), F.count_distinct(EQ).alias("equipment_count"),
        F.count_distinct("rule_id").alias("rule_count"), F.sum("fault_hours").alias("fault_hours"))
    return g.where((C("classification") != "DATA_QUALITY") | (C("score") >= num(10)))


def prioritize(assessed: DataFrame, *, k: int | None = None) -> DataFrame:
    """The findings of each building by class, then score; the first k if asked for."""
    order = Window.partitionBy(SITE).orderBy(F.desc(_rank(C("classification"))), F.desc("score"), "cluster")
    ranked = clusters(assessed).withColumn("priority", F.row_number().over(order))
    return ranked if k is None else ranked.where(C("priority") <= k)


def suppressed(assessed: DataFrame, top: DataFrame) -> DataFrame:
    """Candidates outside the top findings, with the reason."""
    a = assessed.withColumn("cluster", cluster_key())
    rest = a.join(top.select("cluster"), "cluster", "left_anti")
    return rest.select("candidate_key", EQ, "rule_id", "classification", "score", F.when(
        C("classification").isin("LIKELY_FALSE_POSITIVE", "NOT_ACTIONABLE"), C("classification"))
        .otherwise("beyond_top_findings").alias("reason"))


def data_quality_rows(assessed: DataFrame) -> DataFrame:
    return assessed.where(C("classification") == "DATA_QUALITY").select("candidate_key", EQ, "rule_id", "score")


def fault_inventory(assessed: DataFrame, top: DataFrame) -> DataFrame:
    """H-11: every fault, whether a priority finding covers it, and why not."""
    a = assessed.withColumn("cluster", cluster_key())
    keep = top.select("cluster", F.lit(True).alias("_in"))
    j = a.join(keep, "cluster", "left")
    live = ~C("classification").isin("LIKELY_FALSE_POSITIVE", "NOT_ACTIONABLE")
    inside = F.coalesce(C("_in"), F.lit(False)) & live
    return j.select(*ID, "rule_id", "system", "fault_hours", "candidate_key", inside.alias("in_priority"),
                    F.when(~inside, F.when(~live, C("classification")).otherwise("not_in_priority_pack")).alias("suppressed_reason"))


def inventory_rollup(inventory: DataFrame, by: str = "rule_id") -> DataFrame:
    return inventory.groupBy(SITE, by).agg(F.count(F.lit(1)).alias("fault_count"), F.sum("fault_hours").alias("fault_hours"),
                                     F.count(F.when(C("in_priority"), 1)).alias("in_priority"))


def scope_filter(cand: DataFrame, *, systems=(), prefixes=(), rules=(), exclude_rules=()) -> DataFrame:
    """H-12: all non-empty dimensions must match."""
    d = cand
    if systems:
        d = d.where(F.upper("system").isin([s.upper() for s in systems]))
    if prefixes:
        d = d.where(any_of(F.upper(EQ).startswith(p.upper()) for p in prefixes))
    if rules:
        d = d.where(C("rule_id").isin(list(rules)))
    return d.where(~C("rule_id").isin(list(exclude_rules))) if exclude_rules else d


# --- listings --------------------------------------------------------------------------------
def results_listing(results: DataFrame) -> DataFrame:
    """H-14: results with the rule's equipment kinds and confirmation time."""
    table = F.create_map(*[F.lit(x) for i, r in RULES.items() for x in (i, ",".join(r.kinds))])
    secs = F.create_map(*[F.lit(x) for i, r in RULES.items() for x in (i, int(r.confirm))])
    return results.withColumns({"equipment_kinds": F.element_at(table, C("rule_id")),
                                "confirm_seconds": F.element_at(secs, C("rule_id"))})


def status_counts(results: DataFrame, *by) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def top_fault_hours(results: DataFrame, by: str, *, k: int | None = None) -> DataFrame:
    f = results.where(C("status") == FAULT).groupBy(by).agg(F.sum("fault_hours").alias("fault_hours"))
    f = f.orderBy(F.desc("fault_hours"), by)
    return f if k is None else f.limit(k)


def tuning_delta(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """H-15: status counts of two runs and their difference."""
    b, t = (status_counts(x).withColumnRenamed("n", n) for x, n in ((baseline, "baseline"), (tuned, "tuned")))
    return b.join(t, "status", "full_outer").na.fill(0, ["baseline", "tuned"]).withColumn("delta", C("tuned") - C("baseline"))


def tuning_hints(results: DataFrame) -> DataFrame:
    """One row: faults, stale or flat-line faults and whether they dominate, role skips."""
    fault = C("status") == FAULT
    stale = F.count(F.when(fault & C("rule_id").isin("SV-STALE", "SV-FLATLINE"), 1))
    n = F.count(F.when(fault, 1))
    return results.agg(n.alias("faults"), stale.alias("stale_flatline_faults"),
                       ((n > 0) & (stale >= num(0.35) * F.greatest(n, F.lit(1)))).alias("stale_dominates"),
                       F.count(F.when(C("status") == "SKIPPED_MISSING_ROLES", 1)).alias("missing_role_skips"))


def tuning_candidates(results: DataFrame) -> DataFrame:
    ids = ["SV-FLATLINE", "SV-STALE", "VAV-1", "VAV-7", "ECON-3", "OAT-METEO", "PID-HUNT-1"]
    return (results.where((C("status") == FAULT) & C("rule_id").isin(ids)).groupBy("rule_id")
                   .agg(F.count(F.lit(1)).alias("fault_rows"), F.sum("fault_hours").alias("fault_hours")))


