"""Numbers of records over many splits, set-aside records, and migration of mixed trees."""

import csv
import os
import random

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from thermaline.sources import csv_ingest, history as H, legacy, lines


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_equal_a_sequential_read(spark, workdir, small_splits):
    rng = random.Random(4)
    want = {}
    for f, end in (("a", "\n"), ("b", "\r\n"), ("c", "\n")):
        rows = [f"{f}{i},{'x' * rng.randrange(90)}" if rng.random() < 0.9 else rng.choice(["", "   "]) for i in range(400)]
        write(f"{workdir}/in/{f}/h.csv", end.join(rows) + (end if f == "c" else ""))
        want[f] = [r for r in rows if r.strip()]
    out = lines.numbered_lines(spark, f"{workdir}/in", name="h.csv")
    assert out.rdd.getNumPartitions() >= 1 and spark.read.text(f"{workdir}/in/a/h.csv").rdd.getNumPartitions() > 5
    got = {}
    for r in out.collect():
        got.setdefault(r["source_file"].split("/")[-2], {})[r["line_number"]] = r["value"]
    assert {f: [v[k] for k in sorted(v)] for f, v in got.items()} == want
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_cells_equal_the_csv_reader(spark):
    rows = ['a,b,c', ',x,', '"p, q",2,"say ""hi"""', '', '1,,"",4', ' a , "b" ', 'long,"' + "y" * 20000 + '""' * 3000 + '",z', "ä,水,"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, line string")
    got = {r["i"]: r["c"] for r in df.select("i", lines.cells(F.col("line")).alias("c")).collect()}
    for i, row in enumerate(rows):
        parsed = next(csv.reader([row], skipinitialspace=True), [""]) or [""]
        if i != 5:  # the reader keeps the space before a quote as a cell of its own making
            assert got[i] == [c.strip() for c in parsed], row


def test_set_aside_records_have_place_and_reason(spark, workdir, small_splits):
    root = f"{workdir}/pkg"
    write(f"{root}/AHU_1/columns.csv", "col,point_role\ntimestamp_utc,\nsat,sat\nnote,mode\n")
    good = [f"2024-08-01T{h:02d}:{m:02d}:00Z,{h}.5,timestamp_utc of unit" for h in range(6) for m in range(0, 60, 5)]
    bad = {9: ('2024-08-01T00:00:00,1,x', "bad_stamp"), 20: (",5,x", "blank_stamp"), 33: ("2024-08-01T00:00:00Z,1,x,more", "too_many_cells"),
           60: ('2024-08-01T00:00:00Z,1,"open', "open_quote")}
    body = list(good)
    for at in sorted(bad):
        body.insert(at - 1, bad[at][0])
    write(f"{root}/AHU_1/history_wide.csv", "\ufefftimestamp_utc,sat,note\n" + "\n".join(body[:40]) + "\n\n" + "\n".join(body[40:]))
    rows = csv_ingest.read_wide_rows(spark, root, ["sat", "mode"])
    aside = {r["source_row_number"]: (r["line"], r["reason"]) for r in csv_ingest.quarantine(rows).collect()}
    assert aside == bad
    kept = csv_ingest.read_wide_csv(spark, root, ["sat", "mode"])
    assert kept.count() == len(good)  # a cell that reads like the header is data
    assert kept.agg(F.sum("sat")).first()[0] == sum(h + 0.5 for h in range(6)) * 12
    assert [r["source_row_number"] for r in lines.preview(rows, 3).collect()] == [1, 2, 3]


def test_mixed_tree_equals_its_parquet_form(spark, workdir):
    base = (spark.range(90).select(F.concat(F.lit("AHU_"), (F.col("id") % 3).cast("string")).alias("equipment_id"),
            F.timestamp_seconds(1_704_067_200 + F.col("id") * 300).alias("timestamp_utc"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("sat"),
            F.when(F.col("id") % 2 > 0, "occupied").alias("occ_mode")))
    old = f"{workdir}/old"
    for k, kind in enumerate(("parquet", "jsonl", "feather")):
        rows = base.where(F.col("equipment_id") == f"AHU_{k}").drop("equipment_id")
        place = f"{old}/building=B 1/equipment=AHU_{k}"
        os.makedirs(place)
        if kind == "parquet":
            rows.write.parquet(f"{place}/history.parquet")
        elif kind == "jsonl":
            stamped = rows.withColumn("timestamp_utc", F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            write(f"{place}/part.jsonl", "\n".join(r[0] for r in stamped.select(F.to_json(F.struct("*"))).collect()))
        else:
            got = rows.toArrow()
            feather.write_feather(got.slice(0, 10), f"{place}/a.feather", compression="lz4")
            with pa.ipc.new_stream(f"{place}/b.arrow", got.schema) as out:
                out.write_table(got.slice(10), max_chunksize=7)
    write(f"{old}/equipment=X/loose.jsonl", '{"timestamp_utc": "2024-01-01T00:00:00Z", "sat": 1}')
    write(f"{old}/building=B/building=C/equipment=X/two.ndjson", '{"timestamp_utc": "2024-01-01T00:00:00Z", "sat": 1}')
    os.makedirs(f"{old}/building=B/equipment=Y")
    feather.write_feather(pa.table({"sat": [1.0]}), f"{old}/building=B/equipment=Y/unstamped.feather")
    base.where("sat > 29").drop("equipment_id").write.parquet(f"{old}/building=B/equipment=Z/other.parquet")
    found = {r["path"].split("old/")[1]: r for r in legacy.discover(spark, old).collect()}
    assert found["equipment=X/loose.jsonl"]["reason"] == "no building in the path"
    assert found["building=B/building=C/equipment=X/two.ndjson"]["reason"] == "two buildings in the path"
    assert {r["format"] for r in found.values()} == {"parquet", "jsonl", "arrow"}
    assert all(not r["eligible"] for p, r in found.items() if "other.parquet" in p)
    out = f"{workdir}/new"
    report = {(r["building_id"], r["equipment_id"]): (r["rows"], r["migrated"]) for r in H.migrate_legacy(spark, old, out, roles=["sat", "occ_mode"]).collect()}
    assert report == {**{("B 1", f"AHU_{k}"): (30, 30) for k in range(3)}, ("B", "Y"): (1, 0)} and not os.path.exists(out)
    H.migrate_legacy(spark, old, out, dry_run=False, roles=["sat", "occ_mode"])
    cols = ["equipment_id", "timestamp_utc", "sat", "occ_mode"]
    assert sorted(map(str, H.read_history(spark, out, roles=["sat", "occ_mode"]).select(cols).collect())) == sorted(map(str, base.select(cols).collect()))
