"""Splitting long series must not change any result: every operator is compared with a plain
pandas computation while one key holds most rows and blocks are tiny."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermaline.operators import align, confirm, series

C = F.col
TINY = {"target_rows": 60, "bucket_seconds": 3600}


def frame(seed, hot=600):
    rng = np.random.default_rng(seed)
    parts = []
    for key, n in (("hot", hot), ("b", 40), ("c", 1)):
        gaps = rng.choice([60, 300, 300, 900, 20_000], n, p=[0.3, 0.3, 0.2, 0.17, 0.03])
        t = 1_704_067_200 + np.cumsum(gaps)
        parts.append(pd.DataFrame({"equipment_id": key, "sec": t, "f": rng.random(n) < 0.7, "v": np.round(rng.normal(70, 5, n), 2),
                                   "hole": rng.random(n) < 0.6}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    pdf = frame(request.param)
    df = (spark.createDataFrame(pdf).withColumn("building_id", F.lit("B1")).withColumn("timestamp_utc", F.timestamp_seconds("sec"))
          .withColumn("reading", F.when(~C("hole"), C("v"))))
    return pdf, df


def got(df, *cols):
    return df.select("equipment_id", "sec", *cols).toPandas().sort_values(["equipment_id", "sec"]).reset_index(drop=True)


def streaks(pdf):
    def one(g):
        out, n = [], 0
        for f in g["f"]:
            n = n + 1 if f else 0
            out.append(n)
        return pd.Series(out, index=g.index)
    return pdf.groupby("equipment_id", group_keys=False)[["f"]].apply(one)


def test_split_is_used_and_core_rows_are_whole(case):
    pdf, df = case
    s = series.split_series(df, before=5, **TINY)
    blocks = s.where("_core").groupBy("equipment_id").agg(F.count_distinct("_block").alias("n"), F.count("*").alias("rows")).collect()
    by = {r["equipment_id"]: r for r in blocks}
    assert by["hot"]["n"] > 4 and by["b"]["n"] == 1
    assert {k: r["rows"] for k, r in by.items()} == pdf.groupby("equipment_id").size().to_dict()


@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_confirm_rows(case, n):
    pdf, df = case
    want = pdf.assign(c=streaks(pdf) >= n).sort_values(["equipment_id", "sec"]).reset_index(drop=True)
    assert got(confirm.confirm_rows(df, C("f"), n, **TINY), "confirmed")["confirmed"].tolist() == want["c"].tolist()


@pytest.mark.parametrize("seconds", [600.0, 3000.0])
def test_confirm_elapsed(case, seconds):
    pdf, df = case
    want = []
    for key, g in pdf.sort_values(["equipment_id", "sec"]).groupby("equipment_id"):
        t = g["sec"].to_numpy(float)
        dt = np.append(np.diff(t), np.median(np.diff(t)) if len(t) > 1 else 300.0)
        cum = 0.0
        for f, d in zip(g["f"], dt):
            cum = cum + d if f else 0.0
            want.append(bool(f) and cum >= seconds)
    assert got(confirm.confirm_elapsed(df, C("f"), seconds, **TINY), "confirmed")["confirmed"].tolist() == want


def test_forward_dt(case):
    pdf, df = case
    p = pdf.sort_values(["equipment_id", "sec"]).reset_index(drop=True)
    want = (p.groupby("equipment_id")["sec"].shift(-1) - p["sec"]).clip(0, 900).fillna(0.0)
    assert got(confirm.forward_dt(df, cap=900.0, **TINY), "dt")["dt"].tolist() == want.tolist()


def test_runs(case):
    pdf, df = case
    want = set()
    for key, g in pdf.sort_values("sec").groupby("equipment_id"):
        run = (g["f"] != g["f"].shift()).cumsum()
        for _, r in g[g["f"]].groupby(run):
            want.add((key, int(r["sec"].min()), int(r["sec"].max()), len(r), bool(r["sec"].max() == g["sec"].max())))
    rows = confirm.runs(df, C("f"), **TINY).select(
        "equipment_id", F.unix_timestamp("start"), F.unix_timestamp("end"), "samples", "open").collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_fills_and_ordinal(case):
    pdf, df = case
    p = pdf.sort_values(["equipment_id", "sec"]).reset_index(drop=True)
    p["reading"] = p["v"].where(~p["hole"])
    same = lambda a, b: np.allclose(a.to_numpy(float), b.to_numpy(float), equal_nan=True)
    kw = {"bucket_seconds": 3600}
    assert same(got(align.fill_forward(df, ["reading"], **kw), "reading")["reading"], p.groupby("equipment_id")["reading"].ffill())
    assert same(got(align.fill_backward(df, ["reading"], **kw), "reading")["reading"], p.groupby("equipment_id")["reading"].bfill())
    lin = p.groupby("equipment_id")["reading"].transform(lambda s: s.reset_index(drop=True).interpolate("linear", limit_area="inside").to_numpy())
    assert np.allclose(got(align.fill_linear(df, ["reading"], **kw), "reading")["reading"].to_numpy(float), lin.to_numpy(float), atol=1e-4, equal_nan=True)
    assert got(series.ordinal(df, **kw), "_row")["_row"].tolist() == (p.groupby("equipment_id").cumcount() + 1).tolist()


def test_asof_with_distant_match(case, spark):
    pdf, df = case
    right = df.where("v > 74").select("equipment_id", "timestamp_utc", C("v").alias("r"))
    j = align.join_asof_previous(df.select("equipment_id", "timestamp_utc", "sec"), right, ["r"], on=["equipment_id"], bucket_seconds=3600)
    p = pdf.sort_values("sec")
    want = pd.merge_asof(p[["equipment_id", "sec"]], p[p["v"] > 74][["equipment_id", "sec", "v"]], on="sec", by="equipment_id")
    want = want.sort_values(["equipment_id", "sec"])["v"].to_numpy(float)
    assert np.allclose(got(j, "r")["r"].to_numpy(float), want, equal_nan=True)


def test_confirm_is_monotone_and_bounded(case):
    _, df = case
    counts = [confirm.confirm_rows(df, C("f"), n, **TINY).where("confirmed").count() for n in (1, 2, 3, 8)]
    assert counts == sorted(counts, reverse=True)


def test_exact_median(spark):
    from thermaline.operators.quantile import exact_median
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 5000, p=[0.9, 0.09, 0.01]), "v": np.round(rng.exponential(300, 5000), 3)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": "d", "v": [300.0] * 4}), pd.DataFrame({"k": "e", "v": [1.0, 2.0]})])
    got = {r["k"]: r["m"] for r in exact_median(spark.createDataFrame(pdf), ["k"], "v", out="m", accuracy=200).collect()}
    assert got == pytest.approx(pdf.groupby("k")["v"].median().to_dict())
