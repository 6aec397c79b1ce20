"""Two buildings with the same equipment ids, one tree for stream and batch, and gates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermaline.operators import align, confirm, runner, topology
from thermaline.plans import analytics as A
from thermaline.sources import history as H
from thermaline.streaming import live

C = F.col
T0 = dt.datetime(2024, 1, 1)


def site(spark, building, rows=24, shift=0, **roles):
    """One AHU at five minutes; a role is a constant or a function of the row number."""
    data = [(building, "AHU_1", T0 + dt.timedelta(minutes=5 * (i + shift)), *[float(v(i) if callable(v) else v) for v in roles.values()]) for i in range(rows)]
    return spark.createDataFrame(data, "building_id string, equipment_id string, timestamp_utc timestamp, " + ", ".join(f"{r} double" for r in roles))


def by_building(df, value):
    return {(r["building_id"], r["rule_id"] if "rule_id" in df.columns else None): r[value] for r in df.collect()}


@pytest.fixture
def two(spark):
    bad = site(spark, "B1", sat=50, sat_sp=60, htg_valve_pct=95, fan_status=1, oa_t=40, web_oa_t=45)
    return bad, bad.union(site(spark, "B2", sat=60, sat_sp=60, htg_valve_pct=95, fan_status=1, oa_t=80, web_oa_t=70))


def test_rules_keep_buildings_apart(two):
    alone, both = two
    want = runner.run_rule(alone, "FC7").first()["fault_hours"]
    assert want > 0 and {r["building_id"]: r["fault_hours"] for r in runner.run_rule(both, "FC7").collect()} == {"B1": want, "B2": 0.0}
    assert by_building(runner.run_rules(both, ["FC7"]), "status") == {("B1", "FC7"): "FAULT", ("B2", "FC7"): "PASS"}
    assert by_building(runner.run_batch(both, ["FC7"]), "status") == {("B1", "FC7"): "FAULT", ("B2", "FC7"): "PASS"}
    assert by_building(live.rolling_rules(both, ["FC7"]), "status") == {("B1", "FC7"): "FAULT", ("B2", "FC7"): "PASS"}


def test_timestamp_joins_stay_in_the_building(two):
    both = two[1].withColumn("zone_t", F.lit(None).cast("double"))
    assert {(r["building_id"], r["bas_oat_f"], r["delta_f"]) for r in align.bas_vs_web(both).collect()} == {("B1", 40.0, -5.0), ("B2", 80.0, 10.0)}
    bins = A.oat_bins(both, F.lit(True)).where("series_kind = 'aggregate_active_hours'").collect()
    assert {(r["building_id"], r["bin_lo"]) for r in bins} == {("B1", 40.0), ("B2", 80.0)}
    sat = {(r["building_id"], r["ahus_ok"]) for r in topology.load_satisfaction(both).select("building_id", "ahus_ok").distinct().collect()}
    assert sat == {("B1", False), ("B2", True)}


def test_rolling_rules_equal_batch_for_every_rule(spark):
    from conftest import SF
    from thermaline.sources import driver_tables as D
    h = D.history(spark, SF)
    w = D.weather(spark, SF)
    key = lambda df: {(r["building_id"], r["equipment_id"], r["rule_id"]): (r["status"], r["fault_samples"]) for r in df.collect()}
    assert key(live.rolling_rules(h, weather=w, hours=24 * 365)) == key(runner.run_rules(h, weather=w))


def test_equal_stamps_give_one_answer(two):
    rows = two[0].union(two[0].withColumn("sat", F.lit(61.0)))
    got = [runner.run_rule(rows.repartition(n, "sat"), "FC7").first()["fault_hours"] for n in (1, 3, 7)]
    assert len(set(got)) == 1


def test_equipment_without_proof_is_not_gated(spark):
    h = site(spark, "B1", rows=12, sat=50, mat=60, oa_damper_pct=50, clg_valve_pct=0, loop_enabled=0)
    r = runner.run_batch(h, ["FC8", "CHW-1"], kind=F.lit("unknown")).where("rule_id = 'FC8'").first()
    assert r["active_samples"] == 12 and r["status"] == "FAULT"


def test_equipment_that_hardly_runs_is_off(spark):
    h = site(spark, "B1", rows=100, sat=50, sat_sp=60, htg_valve_pct=95, fan_status=lambda i: i < 5)
    assert runner.run_batch(h, ["FC7"]).first()["status"] == "SKIPPED_EQUIPMENT_OFF"
    assert runner.run_batch(h, ["FC7"], min_active_pct=1.0).first()["status"] == "FAULT"


def test_confirmation_over_more_than_a_day(spark):
    h = site(spark, "B1", rows=700, sat=50)
    for target in (50, 500_000):
        c = confirm.confirm_elapsed(h, C("sat") < 55, 36 * 3600.0, target_rows=target)
        assert c.where("confirmed").count() == 700 - 36 * 12 + 1


def test_half_hour_shift_is_ambiguous(spark):
    df = spark.createDataFrame([("2024-04-07 01:45:00",), ("2024-04-07 03:00:00",)], "w string").withColumn("wall", C("w").cast("timestamp"))
    got = {r["w"]: r["ts_status"] for r in align.localize(df, "wall", "Australia/Lord_Howe").collect()}
    assert got == {"2024-04-07 01:45:00": "ambiguous", "2024-04-07 03:00:00": "ok"}


def test_reset_and_hunting_take_the_right_proof(spark):
    h = site(spark, "B1", rows=12, sat_sp=80, oa_t=65, fan_cmd=0.03)
    assert runner.run_rule(h, "RESET-1").first()["fault_hours"] == 0.0
    swing = site(spark, "B1", rows=48, oa_damper_pct=lambda i: 100 * (i % 2), clg_valve_pct=0, fan_cmd=100, fan_status=0)
    assert runner.run_rule(swing, "FC4").first()["fault_hours"] == 0.0
    assert runner.run_rule(swing.withColumn("fan_status", F.lit(1.0)), "FC4").first()["fault_hours"] > 0


def test_stream_and_batch_share_a_tree(spark, workdir):
    tree = f"{workdir}/tree"
    read = lambda: H.read_history(spark, tree, roles=["sat"])
    H.write_history(site(spark, "B1", sat=1), tree)

    def stream(name, shift):
        rows = site(spark, "B1", rows=5, shift=shift, sat=2).withColumns({"message_id": F.lit("m"), "edge_id": F.lit("e"), "duplicate_role": C("timestamp_utc") == F.lit(T0 + dt.timedelta(minutes=5 * shift))})
        rows.coalesce(1).write.mode("append").parquet(f"{workdir}/in")
        q = live.persist(spark.readStream.schema(rows.schema).parquet(f"{workdir}/in"), tree, f"{workdir}/cp", once=True)
        q.awaitTermination(120)

    stream("a", 100)
    assert read().count() == 28 and spark.read.parquet(f"{tree}/rejects").count() == 1
    H.write_history(site(spark, "B2", sat=1), tree)
    stream("b", 200)
    assert read().count() == 56
    again = site(spark, "B1", rows=4, shift=201, sat=2)
    H.replace_batch(again, tree, "stream1")  # a replay replaces what the batch wrote
    assert read().count() == 56
    assert H.compact(spark, tree, min_files=2, roles=["sat"]).count() >= 1
    assert read().count() == 56 and read().distinct().count() == 56
    assert H.purge(spark, tree, building="B2", roles=["sat"]) == 24
    H.write_history(site(spark, "B2", rows=3, sat=7), tree)
    assert read().count() == 35


def test_rows_appended_while_compacting_stay(spark, workdir, monkeypatch):
    tree = f"{workdir}/tree"
    for k in range(3):
        H.write_history(site(spark, "B1", rows=4, shift=10 * k, sat=k), tree)
    publish = H._publish

    def late(*args):
        H.write_history(site(spark, "B1", rows=2, shift=900, sat=9), tree)
        publish(*args)

    monkeypatch.setattr(H, "_publish", late)
    H.compact(spark, tree, min_files=2, roles=["sat"])
    assert H.read_history(spark, tree, roles=["sat"]).count() == 14
