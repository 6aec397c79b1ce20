import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from thermaline.operators import align
from thermaline.plans import fuel
from thermaline.sources import csv_ingest, history as H


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def package(workdir):
    root = f"{workdir}/pkg"
    write(f"{root}/AHU_1/columns.csv", "col,point_role\ntimestamp_utc,\nsat_col,Discharge-Air-Temp\nfan_col,fan-cmd\nocc,occupied\njunk,\n")
    write(f"{root}/AHU_1/history_wide.csv",
          "timestamp_utc,sat_col,fan_col,occ,junk\n2024-07-31T23:55:00Z,55.5,on,occupied,1\n2024-08-01T02:00:00+02:00,56.5,off,,2\n"
          "2024-08-01 00:05:00,57,1,occupied,3\n2024-08-01T00:10:00Z,bad,0.5,unocc,4\n")
    write(f"{root}/VAV_2/columns.csv", "col,point_role\ntimestamp_utc,\nflow_sp,zone_airflow\nactflow,zone_airflow\n")
    write(f"{root}/VAV_2/history_wide.csv", "flow_sp,timestamp_utc,actflow\n10,2024-08-01T00:00:00Z,300\n20,2024-08-01T00:05:00Z,\n")
    return root


ROLES = ["sat", "fan_cmd", "zone_flow", "occ_mode"]


def test_wide_csv(spark, package):
    rows = {(r["equipment_id"], r["timestamp_utc"]): r for r in csv_ingest.read_wide_csv(spark, package, ROLES).collect()}
    assert len(rows) == 5  # the stamp without an offset is left out
    at = lambda e, h, m, d=1, mo=8: rows[(e, dt.datetime(2024, mo, d, h, m))]
    assert at("AHU_1", 23, 55, 31, 7)["fan_cmd"] == 1.0
    assert at("AHU_1", 0, 0)["sat"] == 56.5 and at("AHU_1", 0, 0)["occ_mode"] is None
    assert at("AHU_1", 0, 10)["sat"] is None and at("AHU_1", 0, 10)["occ_mode"] == "unocc"
    assert at("VAV_2", 0, 0)["zone_flow"] == 300.0  # the setpoint column loses


def test_history_tree(spark, package, workdir):
    out = f"{workdir}/tree"
    csv_ingest.ingest_wide_csv(spark, package, out, ROLES, building="B1")
    h = H.read_history(spark, out)
    months = {(r["equipment_id"], r["month"]): r["n"] for r in h.groupBy("equipment_id", "month").agg(F.count("*").alias("n")).collect()}
    assert months == {("AHU_1", "07"): 1, ("AHU_1", "08"): 2, ("VAV_2", "08"): 2}
    assert "mat" in h.columns and h.where("mat is not null").count() == 0
    scoped = H.read_history(spark, out, building="B1", start="2024-08-01 00:00:00", end="2024-08-02 00:00:00")
    assert scoped.count() == 4
    assert H.read_history(spark, out, building="none").count() == 0
    stats = H.historian_stats(spark, out).agg(F.sum("rows"), F.sum("files")).first()
    assert stats[0] == 5 and stats[1] >= 3


def test_compact_and_purge(spark, workdir):
    out = f"{workdir}/tree"
    base = spark.range(40).select(F.lit("B1").alias("building_id"), F.concat(F.lit("AHU_"), (F.col("id") % 2).cast("string")).alias("equipment_id"),
                                  F.timestamp_seconds(1_704_067_200 + F.col("id") * 86_400).alias("timestamp_utc"), F.col("id").cast("double").alias("sat"))
    for lo in range(0, 40, 8):
        H.write_history(base.where((F.col("sat") >= lo) & (F.col("sat") < lo + 8)), out)
    before = H.read_history(spark, out).agg(F.count("*"), F.sum("sat")).first()
    assert H.compact(spark, out, min_files=2, roles=["sat"]).count() > 0
    assert H.read_history(spark, out).agg(F.count("*"), F.sum("sat")).first() == before
    assert H.historian_stats(spark, out).agg(F.max("files")).first()[0] == 1
    preview = {(r["equipment_id"], r["month"]): (r["rows_purged"], r["rows_kept"]) for r in H.purge_preview(spark, out, before="2024-02-03 00:00:00").collect()}
    assert preview[("AHU_0", "01")] == (16, 0) and preview[("AHU_0", "02")] == (1, 3)
    assert H.purge(spark, out, before="2024-02-03 00:00:00", roles=["sat"]) == 33
    assert H.read_history(spark, out).count() == 7
    with pytest.raises(ValueError):
        H.purge(spark, out)


def test_migrate_and_weather(spark, workdir):
    legacy, out = f"{workdir}/old", f"{workdir}/new"
    one = spark.range(3).select(F.timestamp_seconds(1_704_067_200 + F.col("id") * 300).alias("timestamp_utc"), F.lit(70.0).alias("oa_t"))
    one.write.parquet(f"{legacy}/building=B7/equipment=WEATHER_1/history.parquet")
    report = H.migrate_legacy(spark, legacy, out, roles=["oa_t"]).collect()
    assert report[0]["migrated"] == 3 and not os.path.exists(out)
    H.migrate_legacy(spark, legacy, out, dry_run=False, roles=["oa_t"])
    h = H.read_history(spark, out)
    assert h.where("building_id = 'B7'").count() == 3
    assert H.read_weather(spark, out, h).count() == 3 and H.read_weather(spark, out) is None


def test_sql_guard(spark):
    h = spark.createDataFrame([("a", 1.0)], "equipment_id string, sat double").withColumn("building_id", F.lit("B1"))
    ok = H.run_sql(spark, "WITH x AS (SELECT * FROM history) SELECT count(*) AS n FROM x WHERE equipment_id <> 'drop table'", {"history": h})
    assert ok.first()["n"] == 1
    for bad in ("DROP TABLE history", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM parquet.`/etc/x`",
                "INSERT INTO history SELECT * FROM history"):
        with pytest.raises(ValueError):
            H.run_sql(spark, bad, {"history": h})
    with pytest.raises(H.TooManyRows):
        H.bounded(spark.range(11).toDF("x"), 10)


def test_localize_chicago(spark):
    wall = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00"]
    df = spark.createDataFrame([(w,) for w in wall], "w string").withColumn("wall", F.col("w").cast("timestamp"))
    get = lambda amb: {r["w"]: (r["ts_status"], str(r["timestamp_utc"])) for r in align.localize(df, "wall", "America/Chicago", ambiguous=amb).collect()}
    first, second = get("first"), get("second")
    assert first["2024-03-10 02:30:00"][0] == "gap" and first["2024-07-01 12:00:00"] == ("ok", "2024-07-01 17:00:00")
    assert first["2024-11-03 01:30:00"] == ("ambiguous", "2024-11-03 06:30:00")
    assert second["2024-11-03 01:30:00"] == ("ambiguous", "2024-11-03 07:30:00")


def test_append_merge_and_drift(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([("e", t, 1.0), ("e", t + dt.timedelta(hours=1), 2.0)], "equipment_id string, timestamp_utc timestamp, sat double").withColumn("building_id", F.lit("B1"))
    b = spark.createDataFrame([("e", t, 9.0, "B1")], a.schema)
    assert sorted(r["sat"] for r in align.append_merge(a, b).collect()) == [2.0, 9.0]
    assert align.append_report(a, b).first().asDict() == {"rows_in": 1, "rows_new": 0, "rows_overwritten": 1}
    with pytest.raises(align.SchemaDrift):
        align.append_merge(a, b.withColumn("x", F.lit(1)))


def test_bills(spark, workdir):
    write(f"{workdir}/bill.csv", 'Bill Month,kWh Total,Billed Demand (kW),Total Current Charges ($)\n2015-01,1000,50,100.5\n2015-01,200,10,20.0\n201502,"1,500",60,$150\n')
    rows = {r["month"]: r for r in fuel.read_bills(spark, f"{workdir}/bill.csv", meter_id="m").collect()}
    assert (rows["2015-01"]["usage"], rows["2015-01"]["cost_usd"], rows["2015-01"]["demand_kw"]) == (1200.0, 120.5, 50.0)
    assert rows["2015-02"]["usage"] == 1500.0


def test_jdbc_is_read_only(spark):
    with pytest.raises(ValueError):
        H.read_jdbc(spark, "jdbc:x", query="DELETE FROM t")
    with pytest.raises(ValueError):
        H.read_jdbc(spark, "jdbc:x")


