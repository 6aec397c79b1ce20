"""Fuel bills, allocation, intensity, degree-day regression and savings (F-1 to F-12, S-27, J-15).

Bills are rows (meter_id, month 'YYYY-MM', usage, cost_usd, demand_kw); meters are rows
(meter_id, fuel, unit, serves array<string>); buildings are rows (building_id,
floor_area_ft2, property_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from thermaline.functions.logic import num
from thermaline.functions.scalars import with_scalars
from thermaline.functions.weather import saturated_enthalpy_btu_lb

C = F.col
# Site energy per billing unit.
KBTU_PER_KWH, KBTU_PER_MCF, THERMS_PER_MCF = 3.412, 1037.0, 10.37


def month_index(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def month_key(text: Column) -> Column:
    """'YYYY-MM...' or 'YYYYMM' to 'YYYY-MM', anything else NULL."""
    t = F.trim(text)
    return (F.when(t.rlike(r"^.{4}-.{2}"), F.substring(t, 1, 7))
             .when(t.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2))))


def money(text: Column) -> Column:
    x = F.regexp_replace(F.trim(text), "[,$]", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _find(columns, *needles):
    return next((c for c in columns if all(n in c.strip().lower() for n in needles)), None)


def read_bills(spark: SparkSession, path: str, *, meter_id: str) -> DataFrame:
    """S-27: a utility summary CSV; columns are found by name, repeated months are merged."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return tidy_bills(raw).select(F.lit(meter_id).alias("meter_id"), "*")


def tidy_bills(raw: DataFrame, *, by=()) -> DataFrame:
    cols = [c for c in raw.columns if c not in by]
    month = _find(cols, "month") or cols[0]
    usage = _find(cols, "kwh") or _find(cols, "usage") or cols[min(1, len(cols) - 1)]
    cost = _find(cols, "charges") or _find(cols, "cost")
    demand = _find(cols, "billed", "demand") or _find(cols, "demand")
    pick = lambda c: money(C(f"`{c}`").cast("string")) if c else F.lit(None).cast("double")
    d = raw.select(*by, month_key(C(f"`{month}`").cast("string")).alias("month"), pick(usage).alias("usage"),
                   pick(cost).alias("cost_usd"), pick(demand).alias("demand_kw"))
    return (d.where(C("month").isNotNull() & C("usage").isNotNull()).groupBy(*by, "month")
             .agg(F.sum("usage").alias("usage"), F.sum("cost_usd").alias("cost_usd"), F.max("demand_kw").alias("demand_kw")))


def to_kbtu(usage: Column, fuel: Column, unit: Column) -> Column:
    u, f = F.lower(unit), F.lower(fuel)
    return (F.when(f.startswith("elec") | (u == "kwh"), usage * num(KBTU_PER_KWH))
             .when(u.isin("therm", "therms"), usage * num(100)).otherwise(usage * num(KBTU_PER_MCF)))


def complete_windows(bills: DataFrame, months: int = 12) -> DataFrame:
    """F-1: the latest run of `months` consecutive months that every meter has billed, as rows
    (month). Runs are islands of month index minus row number over at most one row per month."""
    meters = bills.agg(F.count_distinct("meter_id").alias("_meters"))
    common = with_scalars(bills.groupBy("month").agg(F.count_distinct("meter_id").alias("_have")), meters)
    common = common.where(C("_have") == C("_meters")).withColumn("_i", month_index(C("month")))
    by_month = Window.partitionBy(F.lit(1)).orderBy("_i")  # one row per calendar month
    runs = common.withColumn("_run", C("_i") - F.row_number().over(by_month))
    ends = (runs.groupBy("_run").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
                .where(C("_hi") - C("_lo") + 1 >= months).agg(F.max("_hi").alias("_end")))
    span = F.sequence(C("_end") - (months - 1), C("_end"))
    return ends.where(C("_end").isNotNull()).select(F.explode(span).alias("_m")).select(month_text(C("_m")).alias("month"))


def shares(meters: DataFrame, buildings: DataFrame, bills: DataFrame, method: str) -> DataFrame:
    """Share of each meter's usage per served building; unshared meters give everything to one."""
    m = meters.select("meter_id", "fuel", F.explode("serves").alias("building_id"))
    m = m.join(buildings.select("building_id", "floor_area_ft2"), "building_id")
    w = Window.partitionBy("meter_id")  # the buildings one meter serves
    area = F.try_divide(C("floor_area_ft2"), F.sum("floor_area_ft2").over(w))
    n = F.count(F.lit(1)).over(w)
    if method == "equal":
        return m.select("meter_id", "building_id", F.try_divide(num(1), n.cast("double")).alias("share"))
    if method == "area_weighted":
        return m.select("meter_id", "building_id", F.when(n == 1, num(1)).otherwise(area).alias("share"))
    if method != "gas_share":
        raise ValueError(f"unknown allocation method {method!r}")
    own = (meters.where((F.lower("fuel") == "gas") & (F.size("serves") == 1))
                 .select("meter_id", F.element_at("serves", 1).alias("building_id"))
                 .join(bills.groupBy("meter_id").agg(F.sum("usage").alias("_u")), "meter_id")
                 .groupBy("building_id").agg(F.sum("_u").alias("_gas")))
    g = m.join(own, "building_id", "left").withColumn("_gas", F.coalesce("_gas", num(0)))
    tot = F.sum("_gas").over(w)
    return g.select("meter_id", "building_id", F.when(n == 1, num(1))
                    .when(tot > num(0), F.try_divide(C("_gas"), tot)).otherwise(area).alias("share"))


def annual_summary(bills: DataFrame, meters: DataFrame, buildings: DataFrame, *, allocation: str = "area_weighted",
                   window: DataFrame | None = None) -> DataFrame:
    """F-2: energy, cost and site EUI per building over the common window."""
    window = complete_windows(bills) if window is None else window
    b = bills.join(window, "month", "left_semi")
    per = b.groupBy("meter_id").agg(F.sum("usage").alias("usage"), F.coalesce(F.sum("cost_usd"), num(0)).alias("cost"))
    kinds = meters.select("meter_id", ((F.lower("fuel") == "electricity") | (F.lower("unit") == "kwh")).alias("elec"))
    x = shares(meters, buildings, b, allocation).join(per, "meter_id").join(kinds, "meter_id")
    s = lambda cond, c: F.coalesce(F.sum(F.when(cond, C(c) * C("share"))), num(0))
    agg = x.groupBy("building_id").agg(
        s(C("elec"), "usage").alias("kwh"), s(~C("elec"), "usage").alias("mcf"),
        s(C("elec"), "cost").alias("elec_cost_usd"), s(~C("elec"), "cost").alias("gas_cost_usd"))
    j = buildings.join(agg, "building_id", "left").na.fill(0.0, ["kwh", "mcf", "elec_cost_usd", "gas_cost_usd"])
    area = F.greatest(C("floor_area_ft2"), num(1))
    return j.withColumns({
        "kwh_per_ft2": C("kwh") / area, "therms": C("mcf") * num(THERMS_PER_MCF),
        "elec_kbtu_ft2": C("kwh") * num(KBTU_PER_KWH) / area, "gas_kbtu_ft2": C("mcf") * num(KBTU_PER_MCF) / area,
        "site_eui_kbtu_ft2": (C("kwh") * num(KBTU_PER_KWH) + C("mcf") * num(KBTU_PER_MCF)) / area})


def campus_summary(annual: DataFrame) -> DataFrame:
    kwh, mcf, area = F.sum("kwh"), F.sum("mcf"), F.greatest(F.sum("floor_area_ft2"), num(1))
    return annual.agg(kwh.alias("kwh"), mcf.alias("mcf"), F.sum("floor_area_ft2").alias("floor_area_ft2"),
                      ((kwh * num(KBTU_PER_KWH) + mcf * num(KBTU_PER_MCF)) / area).alias("site_eui_kbtu_ft2"),
                      F.sum(C("elec_cost_usd") + C("gas_cost_usd")).alias("cost_usd"))


def fuel_monthly(bills: DataFrame, meters: DataFrame, *, gap_fill: bool = False) -> DataFrame:
    """F-3: tidy bills in kBtu; with `gap_fill` also the months a meter lacks between the first
    and last month of the campus, generated per meter from a sequence."""
    m = meters.select("meter_id", "fuel", "unit")
    out = bills.join(m, "meter_id").withColumns({"kbtu": to_kbtu(C("usage"), C("fuel"), C("unit")), "gap": F.lit(False)})
    if not gap_fill:
        return out
    ends = bills.agg(F.min(month_index(C("month"))).alias("_a"), F.max(month_index(C("month"))).alias("_b"))
    grid = (with_scalars(m, ends)
             .select("meter_id", "fuel", "unit", F.explode(F.sequence("_a", "_b")).alias("_i"))
             .select("meter_id", "fuel", "unit", month_text(C("_i")).alias("month")))
    missing = grid.join(bills.select("meter_id", "month"), ["meter_id", "month"], "left_anti")
    return out.unionByName(missing.withColumn("gap", F.lit(True)), allowMissingColumns=True)


def fuel_stacked(bills: DataFrame, meters: DataFrame) -> DataFrame:
    """F-4."""
    return fuel_monthly(bills, meters).groupBy("month", "fuel").agg(
        F.sum("usage").alias("usage"), F.sum("kbtu").alias("kbtu"), F.max("demand_kw").alias("demand_kw"))


def fuel_intensity(bills: DataFrame, meters: DataFrame, buildings: DataFrame, *, building: str | None = None) -> DataFrame:
    """F-5."""
    b = buildings if building is None else buildings.where(C("building_id") == building)
    area = b.agg(F.greatest(F.coalesce(F.sum("floor_area_ft2"), num(0)), num(1)).alias("area_ft2"))
    return (with_scalars(fuel_stacked(bills, meters), area)
            .withColumns({"year": F.substring("month", 1, 4).cast("int"), "mon": F.substring("month", 6, 2).cast("int"),
                          "intensity_kbtu_ft2": C("kbtu") / C("area_ft2")}))


def fuel_demand(bills: DataFrame, meters: DataFrame) -> DataFrame:
    """F-6: billed demand by year and month of the electric meters."""
    e = meters.where(F.lower("fuel") == "electricity").select("meter_id")
    return bills.join(e, "meter_id", "left_semi").select(
        "meter_id", "month", F.substring("month", 1, 4).cast("int").alias("year"),
        F.substring("month", 6, 2).cast("int").alias("mon"), "demand_kw")


def demand_grid(demand: DataFrame) -> DataFrame:
    return demand.groupBy("year").agg(*[F.max(F.when(C("mon") == m, C("demand_kw"))).alias(f"m{m:02d}") for m in range(1, 13)])


def fuel_quality(bills: DataFrame, meters: DataFrame) -> DataFrame:
    """F-7: completeness between a meter's first and last bill, missing months, coverage."""
    i = month_index(C("month"))
    q = bills.groupBy("meter_id").agg(
        F.count_distinct("month").alias("n_months"), F.min("month").alias("span_start"), F.max("month").alias("span_end"),
        F.sort_array(F.collect_set(i)).alias("_have"),
        (num(100) * F.count("cost_usd") / F.count(F.lit(1))).alias("cost_coverage_pct"),
        (num(100) * F.count("demand_kw") / F.count(F.lit(1))).alias("demand_coverage_pct"))
    q = q.withColumn("_all", F.sequence(month_index(C("span_start")), month_index(C("span_end"))))
    miss = F.transform(F.array_except("_all", "_have"), month_text)
    q = q.withColumns({"expected_months": F.size("_all"), "missing_months": F.array_sort(miss)})
    q = q.withColumn("completeness_pct", num(100) * C("n_months") / C("expected_months")).drop("_all", "_have")
    return meters.select("meter_id", "fuel").join(q, "meter_id", "left").na.fill(0, ["n_months", "expected_months"]).na.fill(
        0.0, ["completeness_pct"])


def fuel_weather_points(bills: DataFrame, meters: DataFrame, degree_days: DataFrame) -> DataFrame:
    """F-8 input: usage against HDD for gas and CDD for electricity."""
    f = F.lower("fuel")
    d = degree_days.select("month", "hdd", "cdd")
    return (fuel_stacked(bills, meters).join(d, "month").withColumn(
        "x", F.when(f == "gas", C("hdd")).when(f == "electricity", C("cdd"))).where(C("x").isNotNull()))


def fuel_weather(bills: DataFrame, meters: DataFrame, degree_days: DataFrame, *, least: int = 6) -> DataFrame:
    """F-8: least squares per fuel; needs six months and some spread of degree days."""
    p = fuel_weather_points(bills, meters, degree_days)
    return p.groupBy("fuel").agg(
        F.count(F.lit(1)).alias("n_months"), F.regr_slope("usage", "x").alias("slope"),
        F.regr_intercept("usage", "x").alias("intercept"), F.regr_r2("usage", "x").alias("r2"),
        F.regr_sxx("usage", "x").alias("_sxx")).where((C("n_months") >= least) & (C("_sxx") >= num(1e-12))).drop("_sxx")


# Site EUI of peers, kBtu/ft2: type -> (20th, 50th, 80th percentile).
PEERS = {"office": (34.0, 52.9, 71.0), "k12_school": (31.0, 48.5, 65.0), "retail_store": (33.0, 51.4, 69.0),
         "hospital": (139.0, 214.2, 289.0), "hotel": (41.0, 63.0, 85.0), "warehouse_nonrefrigerated": (15.0, 22.7, 31.0),
         "commercial_all": (46.0, 70.6, 95.0)}
PROPERTY_ALIASES = {
    "office": ["offices", "office_building"], "k12_school": ["school", "k_12", "k12", "primary_school", "secondary_school"],
    "retail_store": ["retail", "store"], "hospital": ["healthcare"], "hotel": ["lodging"],
    "warehouse_nonrefrigerated": ["warehouse"]}


def property_type(c: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    table = F.create_map(*[F.lit(x) for k, names in PROPERTY_ALIASES.items() for a in names for x in (a, k)])
    return F.coalesce(F.try_element_at(table, key), key)


def compare_eui(df: DataFrame, *, eui: str = "site_eui_kbtu_ft2", kind: str = "property_type") -> DataFrame:
    """F-9: position against the peer band; unknown types fall back to all commercial."""
    k = property_type(C(kind))
    known = k.isin(list(PEERS))
    pick = F.when(known, k).otherwise("commercial_all")
    p = [F.element_at(F.create_map(*[F.lit(x) for t, v in PEERS.items() for x in (t, v[i])]), pick) for i in range(3)]
    return df.withColumns({
        "peer_type": pick, "matched": F.when(known, "exact").otherwise("fallback_commercial_all"),
        "p20": p[0], "p50": p[1], "p80": p[2], "vs_median_pct": num(100) * (C(eui) - p[1]) / p[1],
        "band": F.when(C(eui) < p[0], "below_p20").when(C(eui) > p[2], "above_p80").otherwise("within_band")})


# --- weather bins and savings ----------------------------------------------------------------
def weather_bins(df: DataFrame, *, temp: str = "oa_t", width: float = 5.0, ts: str = "timestamp_utc",
                 hours_per_sample: float = 1.0) -> DataFrame:
    """F-10: hours per temperature bin (mid-point) and 8-hour shift."""
    lo = F.floor(C(temp) / num(width)).cast("double") * num(width)
    shift = F.floor(F.hour(ts) / 8)
    return df.where(C(temp).isNotNull()).groupBy((lo + num(width / 2)).alias("temp_f")).agg(
        *[(F.count(F.when(shift == s, 1)) * num(hours_per_sample)).alias(f"shift{s + 1}_h") for s in range(3)])


def schedule_savings(bins: DataFrame, measures: DataFrame) -> DataFrame:
    """F-11: fan, heating and cooling savings of shorter schedules, summed over the bins.

    The bins are a closed set (a few dozen temperatures), so they travel with each measure as
    one array instead of a join that multiplies rows. Measures: measure_id, fan_kw, oa_cfm,
    boiler_efficiency, kw_per_ton, s1..s3 hours existing per shift, days, p1..p3 and pdays
    proposed, balance_f, supply_enthalpy.
    """
    table = bins.withColumn("h_out", saturated_enthalpy_btu_lb("temp_f")).agg(F.sort_array(F.collect_list(
        F.struct("temp_f", "shift1_h", "shift2_h", "shift3_h", "h_out"))).alias("_bins"))  # a few dozen bins
    m = with_scalars(measures, table)
    weekly = lambda p, d: (C(f"{p}1") + C(f"{p}2") + C(f"{p}3")) * C(d)
    cut = F.when(weekly("s", "days") > num(0), (weekly("s", "days") - weekly("p", "pdays")) / weekly("s", "days")).otherwise(num(0))
    run = lambda b: sum((b[f"shift{i}_h"] * C(f"s{i}") / num(8) * C("days") / num(7) for i in (2, 3)),
                        b["shift1_h"] * C("s1") / num(8) * C("days") / num(7))
    total = lambda f: F.aggregate("_bins", num(0), lambda acc, b: acc + f(b))
    fan = total(lambda b: C("fan_kw") * run(b))
    heat = total(lambda b: F.greatest(num(0), num(1.08) * C("oa_cfm") * (C("balance_f") - b["temp_f"]) / num(1000))
                 * run(b) / C("boiler_efficiency") / num(1000))
    cool = total(lambda b: F.greatest(num(0), C("oa_cfm") * (b["h_out"] - C("supply_enthalpy")) * num(4.5) / num(12000))
                 * run(b) * C("kw_per_ton"))
    return m.select("measure_id", cut.alias("hours_reduction_fraction"), (fan * cut).alias("fan_savings_kwh"),
                    (heat * cut).alias("heating_savings_mmbtu"), (heat * cut * num(10)).alias("heating_savings_therms"),
                    (cool * cut).alias("cooling_savings_kwh"))


INPUTS = ("a", "b", "c", "d", "e", "f")


def measure_savings(measures: DataFrame, *, years: int = 15, discount: float = 0.05, escalation: float = 0.0) -> DataFrame:
    """F-12: nine closed forms over a table of measures, then payback and net present value.

    Columns: measure_id, kind, fuel, cost, usd_per_kwh, usd_per_therm and inputs a..f:
    fan_affinity (design kW, hours, baseline speed, proposed speed, exponent);
    schedule_reduction (kW, baseline hours, proposed hours, load);
    boiler_efficiency_improvement (MMBtu, baseline, proposed);
    kw_per_ton_improvement (ton-hours, baseline, proposed);
    outside_air_sensible (cfm, dT, hours, efficiency);
    outside_air_total_cooling (cfm, dh, hours, COP);
    economizer_runtime_cap (observed h, eligible h, realization, tons, load, kW/ton);
    chws_reset_proxy (chiller kWh, reset F, gain, realization, pump kWh);
    condenser_water_proxy (chiller kWh, reduction F, gain, tower before, tower after, pump kWh).
    """
    a, b, c, d, e, f = (C(x) for x in INPUTS)
    k = C("kind")
    pos = lambda x: F.greatest(x, num(0))
    or1 = lambda x, v: F.coalesce(x, num(v))
    sensible = num(1.08) * pos(a) * pos(b) * pos(c) / or1(d, 1)
    gas = F.lower(F.coalesce("fuel", F.lit("natural_gas"))) == "natural_gas"
    kwh = (F.when(k == "fan_affinity", a * pos(b) * (F.pow(c, or1(e, 3)) - F.pow(d, or1(e, 3))))
            .when(k == "schedule_reduction", a * (pos(b) - pos(c)) * or1(d, 1))
            .when(k == "kw_per_ton_improvement", pos(a) * (b - c))
            .when((k == "outside_air_sensible") & ~gas, sensible / num(3412.142))
            .when(k == "outside_air_total_cooling", num(4.5) * pos(a) * pos(b) * pos(c) / num(1e6) * num(293.07107) / d)
            .when(k == "economizer_runtime_cap", F.least(pos(a), pos(b)) * c * pos(d) * pos(e) * f)
            .when(k == "chws_reset_proxy", pos(a) * pos(b) * pos(c) * or1(d, 1) + or1(e, 0))
            .when(k == "condenser_water_proxy", pos(a) * pos(b) * pos(c) + (pos(d) - pos(e)) + or1(f, 0))
            .otherwise(num(0)))
    therms = (F.when(k == "boiler_efficiency_improvement", pos(a) * num(10) / b - pos(a) * num(10) / c)
               .when((k == "outside_air_sensible") & gas, sensible / num(1e5)).otherwise(num(0)))
    m = measures.withColumns({"savings_kwh": kwh, "savings_therms": therms})
    m = m.withColumn("savings_usd", C("savings_kwh") * C("usd_per_kwh") + C("savings_therms") * C("usd_per_therm"))
    g, r = 1.0 + escalation, 1.0 + discount
    npv = F.aggregate(F.sequence(F.lit(1), F.lit(years)), -C("cost"), lambda acc, y: acc + C("savings_usd")
                      * F.pow(num(g), (y - 1).cast("double")) / F.pow(num(r), y.cast("double")))
    return m.withColumns({"payback_years": F.when(C("savings_usd") > num(0), C("cost") / C("savings_usd")), "npv_usd": npv})


BILL_SCHEMA = T.StructType([T.StructField("meter_id", T.StringType()), T.StructField("month", T.StringType()),
                            T.StructField("usage", T.DoubleType()), T.StructField("cost_usd", T.DoubleType()),
                            T.StructField("demand_kw", T.DoubleType())])
