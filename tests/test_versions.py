"""Rewrites of the history tree are seen whole or not at all; a replayed batch replaces its own files by name."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from thermaline.sources import history as H

C = F.col


class Killed(RuntimeError):
    pass


def rows(spark, n=6, first=0, building="B1"):
    return spark.range(first, first + n).select(F.lit(building).alias("building_id"), F.concat(F.lit("AHU "), (C("id") % 2).cast("string")).alias("equipment_id"),
                                                F.timestamp_seconds(1_704_067_200 + C("id") * 3600).alias("timestamp_utc"), C("id").cast("double").alias("sat"))


@pytest.fixture
def tree(spark, workdir):
    out = f"{workdir}/tree"
    for k in range(4):
        H.write_history(rows(spark, first=6 * k), out)
    return out


def seen(spark, out):
    return sorted(r["sat"] for r in H.read_history(spark, out, roles=["sat"]).select("sat").collect())


ALL = [float(n) for n in range(24)]


@pytest.mark.parametrize("step", ["_stage", "_publish", "_commit_json", "_delete"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step_leaves_old_or_new_and_no_row_twice(spark, tree, monkeypatch, step, after):
    real = getattr(H, step)

    def dies(*args, **kw):
        if after:
            real(*args, **kw)
        raise Killed(step)

    monkeypatch.setattr(H, step, dies)
    with pytest.raises(Killed):
        H.compact(spark, tree, min_files=2, roles=["sat"])
    assert seen(spark, tree) == ALL
    assert H.historian_stats(spark, tree).agg(F.sum("rows")).first()[0] == 24
    monkeypatch.setattr(H, step, real)
    H.compact(spark, tree, min_files=2, roles=["sat"])  # goes on from either state
    assert seen(spark, tree) == ALL and H.historian_stats(spark, tree).agg(F.max("files")).first()[0] == 1
    assert H.purge(spark, tree, before="2024-01-01 10:00:00", roles=["sat"]) == 10
    assert seen(spark, tree) == ALL[10:]
    assert H.vacuum(spark, tree) > 0
    assert seen(spark, tree) == ALL[10:]
    left = [f for f in glob.glob(f"{tree}/history/**/*.parquet", recursive=True)]
    assert len(left) == 2 and H.vacuum(spark, tree) == 0


def test_readers_see_one_version_while_files_are_moved(spark, tree, monkeypatch):
    views, real = [], H._publish

    def looking(*args):
        views.append(seen(spark, tree))
        real(*args)
        views.append(seen(spark, tree))

    monkeypatch.setattr(H, "_publish", looking)
    held = H.read_history(spark, tree, roles=["sat"])  # planned before the purge
    H.purge(spark, tree, after="2024-01-01 12:00:00", roles=["sat"])
    assert views == [ALL, ALL] and seen(spark, tree) == ALL[:12]
    assert sorted(r["sat"] for r in held.select("sat").collect()) == ALL  # the old files are there until vacuum


def test_two_rewrites_of_one_file_conflict(spark, tree, monkeypatch):
    real = H._publish

    def other(*args):
        monkeypatch.setattr(H, "_publish", real)
        H.purge(spark, tree, before="2024-01-01 03:00:00", roles=["sat"])
        real(*args)

    monkeypatch.setattr(H, "_publish", other)
    with pytest.raises(H.Conflict):
        H.compact(spark, tree, min_files=2, roles=["sat"])
    assert seen(spark, tree) == ALL[3:]


def test_a_replay_deletes_by_name_and_never_lists_the_tree(spark, tree, monkeypatch):
    H.replace_batch(rows(spark, 4, 100), tree, "stream7")
    names = json.load(open(f"{tree}/_ledger/stream7.json"))
    assert names and all(os.path.exists(f"{tree}/history/{f}") for f in names)
    real, moved = H._publish, []

    def half(spark_, staged, root, prefix):
        fs, _ = H._fs(spark_, staged)
        path = spark_._jvm.org.apache.hadoop.fs.Path
        for f in H._staged_files(spark_, staged)[:1]:
            fs.rename(path(f"{staged}/{f}"), path(f"{root}/history/{H._named(f, prefix)}"))
            moved.append(f)
        raise Killed("half")

    monkeypatch.setattr(H, "_publish", half)
    with pytest.raises(Killed):
        H.replace_batch(rows(spark, 4, 100), tree, "stream7")
    monkeypatch.setattr(H, "_publish", real)
    assert moved
    H.replace_batch(rows(spark, 4, 100), tree, "stream7")
    assert seen(spark, tree) == ALL + [100.0, 101.0, 102.0, 103.0]
    H.forget_batch(spark, tree, "stream7")
    assert not os.path.exists(f"{tree}/_ledger/stream7.json")
