"""Intervals of faults, and stored progress of streams."""

import datetime as dt

from pyspark.sql import functions as F
from test_streaming import drop, envelope, point, run_all

from thermaline.plans import findings as X
from thermaline.streaming import live


def test_open_cleared_reopened(spark):
    cols = "building_id string, equipment_id string, rule_id string, raw_samples long, fault_samples long, severity string"
    at = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    res = lambda *rows: spark.createDataFrame([("B1", "A", r, raw, sure, "info") for r, raw, sure in rows], cols)
    state = spark.createDataFrame([], X.LIFECYCLE)
    clears = spark.createDataFrame([("B1|A|R3", dt.datetime(2024, 1, 4))], "fault_id string, snooze_until timestamp")
    steps = [(1, res(("R1", 3, 0), ("R2", 2, 1), ("R3", 1, 1), ("R4", 0, 0))), (2, res(("R1", 3, 2), ("R2", 0, 0), ("R3", 5, 5))),
             (3, res(("R2", 0, 0))), (5, res(("R2", 1, 1), ("R3", 4, 4)))]
    for d, r in steps:
        for _ in range(2):  # applied twice: the second time changes nothing
            state = spark.createDataFrame(X.update_lifecycle(state, r, now=at(d), clears=clears if d > 1 else None).collect(), X.LIFECYCLE)
    day = lambda t: t and t.day
    got = {(r["rule_id"], r["episode"]): (r["status"], day(r["opened_at"]), day(r["last_seen_at"]), day(r["cleared_at"]), r["cleared_by"]) for r in state.collect()}
    assert got == {("R1", 1): ("confirmed", 1, 2, None, None), ("R2", 1): ("cleared", 1, 1, 2, "recovered"), ("R2", 2): ("confirmed", 5, 5, None, None),
                   ("R3", 1): ("cleared", 1, 1, 2, "user"), ("R3", 2): ("confirmed", 5, 5, None, None)}
    assert X.fault_summary(state).first()["cleared_count"] == 2


def test_progress_survives_restarts_and_replays(spark, workdir):
    src, out, cp = f"{workdir}/in", f"{workdir}/tree", f"{workdir}/cp"
    rows = lambda: live.envelope_rows(live.drop_repeats(live.read_envelope_stream(spark, src, max_files=1)), ["sat"])
    assert live.progress(spark, out) is None
    drop(src, "a", [envelope(i, [point("sat", 50)]) for i in range(10)])
    run_all(live.persist(rows(), out, cp, once=True))
    drop(src, "b", [envelope(i, [point("sat", 50)], mid=f"late{i}") for i in range(3)] + [envelope(3, [point("sat", 1), point("sat", 2)], mid="twice")])
    run_all(live.persist(rows(), out, cp, once=True))  # older stamps only
    got = live.progress(spark, out).collect()
    assert [(r["building_id"], r["watermark"].minute, r["rows"], r["rejects"]) for r in got] == [("B1", 45, 13, 1)]
    counts = spark.createDataFrame([("B1", 5)], "building_id string, rows long")
    for batch in (0, 1, 1, 2, 2):
        live.fold_progress(counts, f"{workdir}/p", batch, ["building_id"], {"rows": F.sum})
    assert spark.read.parquet(f"{workdir}/p/2").first()["rows"] == 15


def test_repeats_are_counted(spark, workdir):
    src, out = f"{workdir}/in", f"{workdir}/tree"
    envs = [envelope(i, [point("sat", 50)]) for i in range(6)]
    drop(src, "a", envs + envs[:2])
    drop(src, "b", envs[1:3])
    drop(src, "c", [envelope(0, [point("sat", 50)], mid="far", minute=60 * 72)])
    run_all(live.count_repeats(live.read_envelope_stream(spark, src), out, f"{workdir}/cp", once=True))
    assert [tuple(r) for r in live.progress(spark, out, "repeats").collect()] == [("e1", 6, 4)]
