"""Psychrometrics and effective outdoor temperature (B-33, B-37, J-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thermaline.functions.roles import ID, SITE, TS
from thermaline.functions.logic import col, num

C = F.col
P_ATM_PSIA = 14.696


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(num(lo), F.least(num(hi), c)))


def dew_point_f(db_f, rh_pct) -> Column:
    """Magnus form with the Sonntag constants."""
    a, b = num(17.625), num(243.04)
    t = (col(db_f) - num(32)) * num(5) / num(9)
    g = F.log(_clip(col(rh_pct), 0.1, 100.0) / num(100)) + a * t / (b + t)
    return b * g / (a - g) * num(9) / num(5) + num(32)


def wet_bulb_f(db_f, rh_pct) -> Column:
    """Stull's empirical wet bulb."""
    t, rh = (col(db_f) - num(32)) * num(5) / num(9), _clip(col(rh_pct), 5.0, 99.0)
    tw = (t * F.atan(num(0.151977) * F.sqrt(rh + num(8.313659))) + F.atan(t + rh) - F.atan(rh - num(1.676331))
          + num(0.00391838) * F.pow(rh, num(1.5)) * F.atan(num(0.023101) * rh) - num(4.686035))
    return tw * num(9) / num(5) + num(32)


def saturation_pressure_psia(t_f) -> Column:
    """Hyland-Wexler over liquid water."""
    t = col(t_f) + num(459.67)
    return F.exp(num(-1.0440397e4) / t - num(1.129465e1) - num(2.7022355e-2) * t + num(1.289036e-5) * t * t
                 - num(2.4780681e-9) * t * t * t + num(6.5459673) * F.log(t))


def humidity_ratio(t_f, rh_fraction, pressure: float = P_ATM_PSIA) -> Column:
    pv = col(rh_fraction) * saturation_pressure_psia(t_f)
    return num(0.621945) * pv / (num(pressure) - pv)


def enthalpy_btu_lb(t_f, w) -> Column:
    return num(0.24) * col(t_f) + col(w) * (num(1061) + num(0.444) * col(t_f))


def saturated_enthalpy_btu_lb(t_f) -> Column:
    return enthalpy_btu_lb(t_f, humidity_ratio(t_f, F.lit(1.0)))


def merge_weather(history: DataFrame, weather: DataFrame, *, ts: str = TS) -> DataFrame:
    """J-11: web readings by timestamp where the row lacks them, derived dew point and wet
    bulb, and the effective OAT: web when there is one, else BAS."""
    w = weather.groupBy(SITE, ts).agg(F.max("web_oa_t").alias("_t"), F.max("web_oa_h").alias("_h"),
                                F.max("web_oa_dp").alias("_dp"))
    h = history.join(w, [SITE, ts], "left")

    def old(c):
        return C(c) if c in history.columns else F.lit(None).cast("double")

    h = h.withColumns({"web_oa_t": F.coalesce(old("web_oa_t"), C("_t")), "web_oa_h": F.coalesce(old("web_oa_h"), C("_h"))})
    h = h.withColumns({
        "web_oa_dp": F.coalesce(old("web_oa_dp"), C("_dp"), dew_point_f("web_oa_t", "web_oa_h")),
        "web_wb_t": F.coalesce(old("web_wb_t"), wet_bulb_f("web_oa_t", "web_oa_h"))})
    return effective_oat(h).drop("_t", "_h", "_dp")


def effective_oat(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "oa_t_effective": F.coalesce("web_oa_t", "oa_t"),
        "oa_t_source": F.when(C("web_oa_t").isNotNull(), "web").when(C("oa_t").isNotNull(), "bas")})


def weather_source_metrics(df: DataFrame) -> DataFrame:
    """B-33: which OAT was used, and how far BAS and web differ, per equipment."""
    diff = F.abs(C("oa_t") - C("web_oa_t"))
    n = F.count(F.lit(1))
    return effective_oat(df).groupBy(*ID).agg(
        (F.count(F.when(C("oa_t_source") == "web", 1)) / n).alias("web_share"),
        (F.count(F.when(C("oa_t_source") == "bas", 1)) / n).alias("bas_share"),
        F.avg(diff).alias("mean_abs_diff_f"), F.max(diff).alias("max_abs_diff_f"))
