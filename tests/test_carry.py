"""Day passes with carried rows: rates, medians and point evaluation against plain computations, at any length of day."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermaline.functions.roles import ID, TS
from thermaline.operators import carry, sensors
from thermaline.sources import driver_tables

C = F.col


def series(seed, n=700):
    rng = np.random.default_rng(seed)
    gaps = rng.choice([60, 300, 300, 900, 20_000], n, p=[0.25, 0.3, 0.25, 0.17, 0.03])
    value = np.round(70 + np.cumsum(rng.normal(0, 2, n)), 2)
    value[rng.random(n) < 0.1] = np.nan
    return 1_704_067_200 + np.cumsum(gaps), value


def plain_rates(sec, value, n):
    out = {"dt_hours": [], "instantaneous_rate": [], "rate_5min": [], "rate_15min": [], "rate_60min": [], "robust_slope_15min": []}
    for k in range(len(sec)):
        dt = (sec[k] - sec[k - 1]) / 3600 if k and 0 < sec[k] - sec[k - 1] <= 7200 else np.nan
        out["dt_hours"].append(dt)
        out["instantaneous_rate"].append(abs(value[k] - value[k - 1]) / dt if k else np.nan)
        for m in (5, 15, 60):
            near = [(abs(s - (sec[k] - 60 * m)), -s, v) for s, v in zip(sec, value, strict=True) if abs(s - (sec[k] - 60 * m)) <= 60 * max(2, m // 2)]
            out[f"rate_{m}min"].append(abs(value[k] - min(near)[2]) / (m / 60) if near else np.nan)
    out["robust_slope_15min"] = pd.Series(out["instantaneous_rate"]).rolling(n, min_periods=3).median().to_numpy()
    return pd.DataFrame(out)


@pytest.mark.parametrize("rows,least", [(3, 3), (15, 3), (1, 1), (200, 5)])
def test_rolling_median(rows, least):
    rng = np.random.default_rng(rows)
    x = np.round(rng.normal(size=400), 1)
    x[rng.random(400) < 0.3] = np.nan
    want = pd.Series(x).rolling(rows, min_periods=least).median().to_numpy()
    np.testing.assert_allclose(carry.rolling_median(x, rows, least), want)
    assert len(carry.rolling_median(x[:0], rows, least)) == 0
    assert np.isnan(carry.rolling_median(np.full(5, np.nan), 3, 1)).all()


def test_nearest_takes_the_later_of_equally_near_and_respects_the_tolerance():
    t, x = np.array([0, 10, 10, 30, 50]), np.array([1.0, 5.0, 2.0, 3.0, np.nan])
    assert carry.nearest(t, x, np.array([20, 12, 4, -9, 61, 5]), 10).tolist()[:4] == [3.0, 2.0, 1.0, 1.0]
    assert np.isnan(carry.nearest(t, x, np.array([61, 45]), 10)).all()
    assert np.isnan(carry.nearest(t, x, np.array([-11]), 10)).all()


@pytest.mark.parametrize("hours", [1, 24, 24 * 4000])
@pytest.mark.parametrize("poll", [300.0, 60.0])
def test_compute_rates(spark, monkeypatch, hours, poll):
    monkeypatch.setattr(carry, "SPAN", hours * 3_600_000_000)
    frames = []
    for key, seed in (("a", 1), ("b", 2)):
        sec, value = series(seed)
        frames.append(pd.DataFrame({"building_id": "B", "equipment_id": key, "role": "sat", "sec": sec, "value": value}))
    df = spark.createDataFrame(pd.concat(frames)).withColumn(TS, F.timestamp_seconds("sec")).withColumn("value", F.when(~F.isnan("value"), C("value")))
    out = sensors.compute_rates(df, sample_seconds=poll)
    assert out.columns[:6] == df.columns
    got = out.toPandas().sort_values(["equipment_id", "sec"])
    for key, seed in (("a", 1), ("b", 2)):
        sec, value = series(seed)
        want = plain_rates(sec, value, sensors.median_rows(poll))
        mine = got[got["equipment_id"] == key]
        assert (mine[TS].astype("int64").to_numpy() // (10**9 if "ns" in str(mine[TS].dtype) else 10**6) == mine["sec"]).all()
        for c in want:
            np.testing.assert_allclose(mine[c].to_numpy(dtype=float), want[c].to_numpy(dtype=float), err_msg=c)


def points(spark):
    h = driver_tables.history(spark, "/root/testdata/sf0.001")
    roles = ["zone_t", "sat", "duct_static"]
    return h, roles


def test_any_length_of_day_gives_one_answer(spark, monkeypatch):
    h, roles = points(spark)
    seen = []
    for hours in (1, 24, 24 * 4000):
        monkeypatch.setattr(carry, "SPAN", hours * 3_600_000_000)
        rows = sensors.evaluate_points(h, roles).toPandas().sort_values([*ID, "role"]).reset_index(drop=True)
        seen.append(rows)
    for other in seen[1:]:
        pd.testing.assert_frame_equal(seen[0], other, rtol=1e-9)
    assert seen[0]["violation_count"].sum() > 0


def test_at_most_five_exchanges(spark):
    h, roles = points(spark)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = str(h._jdf.queryExecution().executedPlan()).count("Exchange ")
        plan = str(sensors.evaluate_points(h, roles)._jdf.queryExecution().executedPlan())
        own = plan.count("Exchange ") - plan.count("ReusedExchange ")
        assert own - base <= 5, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_last_sample_counts_the_median_spacing(spark):
    """A run of the last two samples is confirmed where the time covered, the usual spacing after the last included, reaches ten minutes."""
    def frame(gap):
        rows = [("B", "e", 1_704_067_200 + gap * k, 70.0 + 4.0 * max(0, k - 8)) for k in range(12)]
        return spark.createDataFrame(rows, "building_id string, equipment_id string, sec long, zone_t double").withColumn(TS, F.timestamp_seconds("sec")).drop("sec")

    count = {g: sensors.evaluate_points(frame(g), ["zone_t"], poll=300.0).first()["violation_count"] for g in (900, 400, 240)}
    assert count == {900: 2, 400: 1, 240: 0}
    assert sensors.evaluate_points(frame(300).limit(0), ["zone_t"]).collect() == []
