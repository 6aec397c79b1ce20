import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from thermaline.operators import runner
from thermaline.operators.rules import RULES

T0 = dt.datetime(2024, 1, 1)


def hist(spark, rows, step=300, eq="AHU_1", **const):
    cols = sorted({k for r in rows for k in r} | set(const))
    data = [(eq, T0 + dt.timedelta(seconds=step * i), *[({**const, **r}).get(c) for c in cols]) for i, r in enumerate(rows)]
    typ = lambda c: "string" if c == "occ_mode" else "double"
    return spark.createDataFrame(data, "equipment_id string, timestamp_utc timestamp, " + ", ".join(f"{c} {typ(c)}" for c in cols)).withColumn("building_id", F.lit("B1"))


def hours(df):
    return {r["equipment_id"]: r["fault_hours"] for r in df.collect()}


def test_catalogue_is_complete():
    assert len(RULES) == 66
    assert all(r.raw or r.aggs for r in RULES.values())


FC7 = dict(sat_sp=60.0, htg_valve_pct=95.0, fan_status=1.0)


@pytest.mark.parametrize("sat, want", [(50.0, 11), (60.0, 0), (59.0, 0), (58.99, 11)])
def test_fc7_normal_fault_boundary(spark, sat, want):
    # 12 faulty rows, confirmed from the second on.
    got = hours(runner.run_rule(hist(spark, [{"sat": sat}] * 12, **FC7), "FC7"))
    assert got["AHU_1"] == pytest.approx(want * 300 / 3600)


def test_fc7_off_and_unproven(spark):
    off = {**FC7, "fan_status": 0.0}
    assert hours(runner.run_rule(hist(spark, [{"sat": 50.0}] * 12, **off), "FC7"))["AHU_1"] == 0
    none = {k: v for k, v in FC7.items() if k != "fan_status"}
    assert hours(runner.run_rule(hist(spark, [{"sat": 50.0}] * 12, **none), "FC7"))["AHU_1"] == 0
    # A rule whose default is "on" still evaluates without proof.
    h = hist(spark, [{"mat": 40.0, "oa_t": 60.0, "rat": 70.0}] * 4)
    assert hours(runner.run_rule(h.withColumn("fan_cmd", F.lit(None).cast("double")), "FC2"))["AHU_1"] == pytest.approx(0.25)


def test_streak_survives_gap_and_breaks_on_clear(spark):
    rows = [{"sat": 50.0}] * 3 + [{"sat": 60.0}] + [{"sat": 50.0}] * 3
    assert hours(runner.run_rule(hist(spark, rows, **FC7), "FC7"))["AHU_1"] == pytest.approx(4 * 300 / 3600)
    gap = hist(spark, [{"sat": 50.0}] * 6, **FC7).where("minute(timestamp_utc) not in (10, 15)")
    assert hours(runner.run_rule(gap, "FC7"))["AHU_1"] == pytest.approx(3 * 300 / 3600)


def test_missing_required_role_is_a_skip(spark):
    h = hist(spark, [{"sat_sp": 60.0, "htg_valve_pct": 95.0}] * 3)
    r = runner.run_rule(h, "FC7").collect()
    assert r[0]["status"] == runner.MISSING and r[0]["missing"] == "sat"
    assert {x["status"] for x in runner.run_rules(h, ["FC7"]).collect()} == {runner.MISSING}


def test_vav1_drops_null_rows_before_streaks(spark):
    rows = [{"zone_t": 80.0}, {"zone_t": None}, {"zone_t": 80.0}, {"zone_t": None}, {"zone_t": 80.0}]
    r = runner.run_rule(hist(spark, rows, eq="VAV_1", occ_mode="occupied"), "VAV-1").collect()[0]
    assert r["fault_hours"] == pytest.approx(300 / 3600) and r["fault_pct"] == pytest.approx(100 / 3)


def test_vav4_two_stages(spark):
    # 1.5 h sustained (18 rows), then 3 rows to confirm: the 20th row is the first confirmed.
    h = hist(spark, [{"damper_pct": 100.0, "zone_flow": 300.0}] * 25, eq="VAV_1", fan_status=1.0)
    assert hours(runner.run_rule(h, "VAV-4"))["VAV_1"] == pytest.approx(6 * 300 / 3600)


def test_sched247_is_all_or_nothing(spark):
    on = [{"fan_status": 1.0}] * 95 + [{"fan_status": 0.0}] * 5
    assert hours(runner.run_rule(hist(spark, on), "SCHED-247"))["AHU_1"] == pytest.approx(84 * 300 / 3600)
    less = [{"fan_status": 1.0}] * 94 + [{"fan_status": 0.0}] * 6
    assert hours(runner.run_rule(hist(spark, less), "SCHED-247"))["AHU_1"] == 0


def test_other_poll_interval(spark):
    h = hist(spark, [{"sat": 50.0}] * 30, step=60, **FC7)
    # 600 s at 60 s = 10 rows.
    assert hours(runner.run_rule(h, "FC7", poll=60.0))["AHU_1"] == pytest.approx(21 * 60 / 3600)


def test_params_layers():
    p = runner.effective_params("FC7", {"FC7": {"sat_err": 2}}, None, {"FC7": {"sat_err": 99}})
    assert p["sat_err"] == 10.0 and p["htg_full_min"] == 0.9
    with pytest.raises(KeyError):
        runner.effective_params("FC7", {"FC7": {"nope": 1}})
    assert RULES["FC1"].confirm_rows(RULES["FC1"].settings(60.0)) == 5
    assert RULES["VAV-7"].lookback(RULES["VAV-7"].settings(900.0)) == 5  # never fewer than 6 rows


def test_batch_statuses(spark):
    rows = [{"sat": 50.0}] * 12
    ahu, off = hist(spark, rows, **FC7), hist(spark, rows, eq="AHU_2", **{**FC7, "fan_status": 0.0})
    vav = hist(spark, rows, eq="VAV_9", **FC7)
    got = {r["equipment_id"]: r for r in runner.run_batch(ahu.union(off).union(vav), ["FC7"]).collect()}
    assert got["AHU_1"]["status"] == "FAULT" and got["AHU_2"]["status"] == runner.OFF and got["VAV_9"]["status"] == runner.NOT_APPLICABLE
    # 600 s startup delay removes the first row, confirmation one more.
    assert got["AHU_1"]["fault_hours"] == pytest.approx(10 * 300 / 3600)
    assert got["AHU_1"]["fault_pct"] == pytest.approx(100 * 10 / 11)


def test_single_and_all_rules_agree_under_splitting(spark):
    rows = [{"duct_static": 0.5 if (i // 7) % 2 else 1.6, "oa_t": 50 + 30 * math.sin(i / 3), "mat": 60.0 + (i % 5), "rat": 72.0,
             "oa_damper_pct": 80.0 if i % 2 else 5.0} for i in range(400)]
    h = hist(spark, rows, duct_static_sp=1.5, fan_cmd=95.0, fan_status=1.0, clg_valve_pct=0.0)
    ids = ["FC1", "FC2", "FC3", "FC4", "WX-1", "SV-SPIKE", "SV-FLATLINE", "SV-RATE", "PID-HUNT-1", "ECON-2", "OA-1"]
    whole = {r["rule_id"]: r["fault_samples"] for r in runner.run_rules(h, ids).collect()}
    cut = {r["rule_id"]: r["fault_samples"] for r in runner.run_rules(h, ids, target_rows=50, bucket_seconds=3600).collect()}
    assert whole == cut and sum(v > 0 for v in whole.values()) >= 5


def test_custom_rules(spark):
    h = hist(spark, [{"sat": float(50 + i)} for i in range(10)])
    assert runner.simple_rule(h, "sat", ">=", 55).where("fault_raw").count() == 5
    assert runner.custom_rule(h, "sat > ${x}", params={"x": 54.5}, confirm_rows=2).where("confirmed").count() == 4
    m = runner.custom_mask(h, lambda pdf: pdf["sat"].rolling(3).mean() > 55, ["sat"], target_rows=5, before=3)
    assert m.where("fault_raw").count() == 3
