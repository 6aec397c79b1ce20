"""A stream must give what the batch operator gives on the same rows."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from thermaline.operators import confirm, runner
from thermaline.sources import history as H
from thermaline.streaming import live

T0 = dt.datetime(2024, 1, 1)
C = F.col


def envelope(i, points, mid=None, minute=None):
    at = T0 + dt.timedelta(minutes=5 * i if minute is None else minute)
    return {"schema": "v1", "message_id": mid or f"m{i}", "sequence": i, "observed_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "site_id": "s",
            "edge_id": "e1", "protocol": "p", "device_id": "d", "points": points}


def point(role, value, eq="AHU_1", quality="good", tagged=True):
    t = {"building_id": "B1", "equipment_id": eq, "role": role if tagged else None}
    return {"id": role, "kind": "number", "value": str(value), "quality": quality, "tags": {k: v for k, v in t.items() if v is not None}}


def drop(path, name, envs):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in envs)


def run_all(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_points_and_rows(spark, workdir):
    drop(f"{workdir}/in", "a", [
        envelope(0, [point("sat", 55), point("fan_status", "true"), point("mat", 60, quality="bad"), point("zone_t", 70, eq="VAV_1"), point("rat", 1, tagged=False)]),
        envelope(1, [point("sat", 55), point("sat", 56)])])
    env = spark.read.schema(live.ENVELOPE).json(f"{workdir}/in")
    p = {(r["equipment_id"], r["role"], r["message_id"]): r["value"] for r in live.envelope_points(env).collect()}
    assert p[("AHU_1", "fan_status", "m0")] == 1.0 and p[("AHU_1", "mat", "m0")] is None and ("AHU_1", "rat", "m0") not in p
    rows = {(r["message_id"], r["equipment_id"]): r for r in live.envelope_rows(env, ["sat", "mat", "fan_status", "zone_t"]).collect()}
    assert rows[("m0", "AHU_1")]["sat"] == 55.0 and rows[("m0", "AHU_1")]["mat"] is None and rows[("m0", "VAV_1")]["zone_t"] == 70.0
    assert rows[("m1", "AHU_1")]["duplicate_role"] and not rows[("m0", "AHU_1")]["duplicate_role"]


def test_persist_drops_repeats_and_rolling_rules_match_batch(spark, workdir):
    src, out = f"{workdir}/in", f"{workdir}/tree"
    envs = [envelope(i, [point("sat", 50 if i % 10 else 60), point("sat_sp", 60), point("htg_valve_pct", 95), point("fan_status", 1)]) for i in range(60)]
    drop(src, "a", envs[:40] + envs[5:8])       # repeats inside a batch
    drop(src, "b", envs[41:] + envs[38:41])     # one late row, more repeats
    env = live.drop_repeats(live.read_envelope_stream(spark, src, max_files=1))
    roles = ["sat", "sat_sp", "htg_valve_pct", "fan_status"]
    run_all(live.persist(live.envelope_rows(env, roles), out, f"{workdir}/cp", once=True))
    h = H.read_history(spark, out, roles=roles)
    assert h.count() == 60 and h.select("timestamp_utc").distinct().count() == 60
    assert live.telemetry_watermark(h).first()["watermark"] == T0 + dt.timedelta(minutes=295)
    rolled = live.rolling_rules(h, ["FC7", "AHU-SATDEV"], hours=48).collect()
    batch = {r["rule_id"]: r["fault_samples"] for r in runner.run_rules(h, ["FC7", "AHU-SATDEV"]).collect()}
    assert {r["rule_id"]: r["fault_samples"] for r in rolled} == batch and batch["FC7"] > 0
    # A short window still confirms on its lead-in: 24 rows, three of them clear, one re-confirming each.
    short = {r["rule_id"]: r["fault_samples"] for r in live.rolling_rules(h, ["FC7"], hours=2).collect()}
    flags = runner.confirmed_series(h, "FC7").where(C("timestamp_utc") > F.lit(T0 + dt.timedelta(minutes=175))).where("confirmed").count()
    assert short["FC7"] == flags


def test_rolling_afdd_writes_latest_results(spark, workdir):
    src, out = f"{workdir}/in", f"{workdir}/tree"
    roles = ["sat", "sat_sp", "htg_valve_pct", "fan_status"]
    drop(src, "a", [envelope(i, [point("sat", 50), point("sat_sp", 60), point("htg_valve_pct", 95), point("fan_status", 1)]) for i in range(12)])
    rows = live.envelope_rows(live.read_envelope_stream(spark, src), roles)
    run_all(live.persist(rows, out, f"{workdir}/cp1", once=True))
    schema = H.read_history(spark, out, roles=roles).schema
    run_all(live.rolling_afdd(rows, f"{out}/history", f"{workdir}/res", ["FC7"], f"{workdir}/cp2", schema=schema))
    res = live.latest_results(spark, f"{workdir}/res").collect()
    assert [(r["equipment_id"], r["rule_id"], r["fault_samples"]) for r in res] == [("AHU_1", "FC7", 11)]


def test_live_confirmation_equals_batch(spark, workdir):
    flags = [("B1", f"AHU_{k}", "FC1", T0 + dt.timedelta(minutes=5 * i), bool((i * 7 + k) % 5)) for k in range(3) for i in range(40)]
    batch = spark.createDataFrame(flags, "building_id string, equipment_id string, rule_id string, timestamp_utc timestamp, raw_fault boolean")
    # Out of order inside and across files, within the lateness bound.
    order = sorted(range(40), key=lambda i: i ^ 1)
    for n, lo in enumerate(range(0, 40, 10)):
        part = [f for f in flags if order.index(int((f[3] - T0).total_seconds() // 300)) // 10 == n]
        spark.createDataFrame(part[::-1], batch.schema).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
    far = [("B1", "AHU_0", "end", T0 + dt.timedelta(days=2), False)]
    spark.createDataFrame(far, batch.schema).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{workdir}/in")
    q = (live.confirm_stream(stream, 3, delay="1 hour").writeStream.format("parquet").option("path", f"{workdir}/out")
         .option("checkpointLocation", f"{workdir}/cp").trigger(availableNow=True).start())
    run_all(q)
    got = {(r["equipment_id"], r["timestamp_utc"]): r["confirmed"] for r in spark.read.schema(live.CONFIRM_SCHEMA).parquet(f"{workdir}/out").collect()}
    want = {(r["equipment_id"], r["timestamp_utc"]): r["confirmed"] for r in confirm.confirm_rows(batch, C("raw_fault"), 3).collect()}
    assert {k: v for k, v in got.items() if k in want} == want


def test_stream_means_equal_batch(spark, workdir):
    rows = spark.range(200).select(F.concat(F.lit("E"), (C("id") % 3).cast("string")).alias("equipment_id"), F.lit("B1").alias("building_id"),
                                   F.timestamp_seconds(1_704_067_200 + C("id") * 47).alias("timestamp_utc"), (C("id") * 1.5).alias("v"))
    rows.coalesce(1).write.parquet(f"{workdir}/in")
    q = (live.stream_means(spark.readStream.schema(rows.schema).parquet(f"{workdir}/in"), ["v"]).writeStream.format("memory").queryName("means")
         .outputMode("complete").trigger(availableNow=True).start())
    run_all(q)
    from thermaline.operators.align import downsample_mean
    key = lambda d: sorted((r["equipment_id"], r["timestamp_utc"], round(r["v"], 9)) for r in d.collect())
    assert key(spark.table("means")) == key(downsample_mean(rows, ["v"]))


def test_backfill_chunks_cover_the_range(spark):
    c = live.backfill_chunks(spark, "2024-01-01 00:00:00", "2024-01-03 06:00:00", 24).orderBy("chunk_start").collect()
    assert [r["chunk_start"].day for r in c] == [1, 2, 3] and c[-1]["chunk_end"] == dt.datetime(2024, 1, 3, 6)
    assert c[1]["read_from"] == dt.datetime(2024, 1, 1, 21)
