import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermaline.operators import runner, topology
from thermaline.plans import analytics as A, findings as X
from thermaline.sources import driver_tables as D
from conftest import SF

C = F.col
T0 = dt.datetime(2024, 1, 1)


def test_runtime_is_one_hour(spark):
    rows = [("AHU_1", T0 + dt.timedelta(seconds=300 * i), True) for i in range(13)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp_utc timestamp, on boolean").withColumn("building_id", F.lit("B1"))
    r = A.runtime_hours(df, C("on")).first()
    assert r["run_hours"] == 1.0 and r["coverage_pct"] == 100.0 and r["samples"] == 13
    gap = df.where("minute(timestamp_utc) not in (10, 15, 20, 25, 30, 35, 40)")
    assert A.runtime_hours(gap, C("on")).first()["run_hours"] == pytest.approx((4 * 300 + 900) / 3600)


def test_unknown_never_becomes_a_pass(spark):
    res = spark.createDataFrame([("AHU_1", "AHU-SATDEV", "FAULT", 2.0), ("AHU_1", "AHU-DUCTHI", "SKIPPED_MISSING_ROLES", None),
                                 ("AHU_1", "ECON-1", "SKIPPED_EQUIPMENT_OFF", 0.0), ("AHU_1", "ECON-2", "PASS", 0.0)],
                                "equipment_id string, rule_id string, status string, fault_hours double").withColumn("building_id", F.lit("B1"))
    m = A.health_matrix(res, "ahu_legacy").first()
    assert m["sat_dev"] is True and m["duct_high"] is None and m["economizer"] is False  # the fallback rule passed
    assert m["score_label"] == "?/3" and m["dimensions_hit"] == 1 and m["total_fault_h"] == 2.0


def test_occupancy_calendar():
    assert A.hours_per_week() == 50.0
    assert A.hours_per_week([(True, 1320, 360)] + [(False, 0, 0)] * 6) == 8.0


def test_fill_occ_mode_only_where_nothing_is_reported(spark):
    rows = [("a", T0 + dt.timedelta(hours=9), "night"), ("a", T0 + dt.timedelta(hours=10), None), ("b", T0 + dt.timedelta(hours=9), None)]
    df = spark.createDataFrame(rows, "equipment_id string, timestamp_utc timestamp, occ_mode string").withColumn("building_id", F.lit("B1"))
    got = sorted((r["equipment_id"], r["timestamp_utc"].hour, r["occ_mode"]) for r in A.fill_occ_mode(df).collect())
    assert got == [("a", 9, "night"), ("a", 10, None), ("b", 9, "occupied")]


def test_every_preset_plans(spark):
    h = D.history(spark, SF)
    res = spark.createDataFrame([], "equipment_id string, rule_id string, status string, fault_hours double").withColumn("building_id", F.lit("B1"))
    assert len(A.PRESETS) == 29
    for name in A.PRESETS:
        assert len(A.preset(name, h, results=res).columns) >= 2


def test_analytics_dump(spark, workdir):
    h = D.history(spark, SF)
    out = A.analytics_dump(h, runner.run_rules(h, ["VAV-5"]), workdir)
    assert all(spark.read.option("header", True).csv(p).count() > 0 for p in out.values())


def test_scores(spark):
    base = [("VAV_1", "VAV-5", "FAULT", 400.0, 50.0), ("AHU_1", "FC1", "FAULT", 100.0, 99.0), ("CHILLER_1", "CHW-1", "FAULT", 2000.0, 99.0)]
    res = spark.createDataFrame(base, "equipment_id string, rule_id string, status string, fault_hours double, fault_pct double").withColumn("building_id", F.lit("B1"))
    spot = spark.createDataFrame([("VAV_1", 2.0, 300.0)], "equipment_id string, damper_pct double, airflow double").withColumn("building_id", F.lit("B1"))
    a = {r["rule_id"]: r for r in X.assess(X.candidates(res), spot=spot).collect()}
    assert a["VAV-5"]["score"] == 62.0 and a["VAV-5"]["classification"] == "PROBABLE"
    assert a["FC1"]["classification"] == "LIKELY_FALSE_POSITIVE" and a["FC1"]["score"] == 35.5
    assert a["CHW-1"]["score"] == 30.0 and a["CHW-1"]["common_mode"]
    top = X.prioritize(X.assess(X.candidates(res), spot=spot)).collect()
    assert [t["cluster"] for t in top] == ["vavflow|B1|VAV_1"]
    assert X.suppressed(X.assess(X.candidates(res)), X.prioritize(X.assess(X.candidates(res)), k=1)).count() >= 2


def test_single_ahu_fallback_and_candidates(spark):
    v = spark.createDataFrame([("VAV_7",), ("VAV_8",)], "equipment_id string").withColumn("building_id", F.lit("B1"))
    one = spark.createDataFrame([("RTU_1",)], "equipment_id string").withColumn("building_id", F.lit("B1"))
    assert {r["parent_ahu"] for r in topology.infer_parent(v, one).collect()} == {"RTU_1"}
    two = spark.createDataFrame([("RTU_1",), ("RTU_2",)], "equipment_id string").withColumn("building_id", F.lit("B1"))
    assert {r["parent_ahu"] for r in topology.infer_parent(v, two).collect()} == {None}
    gaps = spark.createDataFrame([("AHU_1", ["duct_static"])], "equipment_id string, missing array<string>").withColumn("building_id", F.lit("B1"))
    cols = spark.createDataFrame([("AHU_1", c) for c in ("Duct-Static-1", "static_p", "sat")], "equipment_id string, column string").withColumn("building_id", F.lit("B1"))
    got = [(r["column"], r["score"]) for r in topology.candidate_columns(gaps, cols).orderBy("rank").collect()]
    assert got == [("Duct-Static-1", 7), ("static_p", 1)]
