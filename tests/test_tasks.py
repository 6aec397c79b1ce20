"""Windows never sort more than a few blocks in one task, however well the rows compress."""

import pytest
from pyspark.sql import functions as F

from thermaline.operators import runner, sensors, series

ROWS, SERIES = 2000, 24


@pytest.fixture(scope="module")
def history(spark):
    h = spark.range(ROWS * SERIES).selectExpr("'B1' AS building_id", f"concat('AHU_', id % {SERIES}) AS equipment_id",
                                              f"timestamp_seconds(1704067200 + (id div {SERIES}) * 300) AS timestamp_utc",
                                              *[f"cast((id * {k + 3}) % 97 AS double) AS {r}" for k, r in enumerate(sensors.SWEEP_ROLES)],
                                              "1.0D AS fan_status", "cast(id % 50 as double) AS duct_static_sp", "cast(id % 101 as double) AS fan_cmd")
    return h.cache()


def most(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rules_are_dealt_by_rows(history, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_BYTES", series.BLOCK_BYTES // 64)
    monkeypatch.setattr(series, "TASK_BYTES", series.TASK_BYTES // 64)
    flags = runner.confirmed_series(history, "FC1")
    assert flags.count() == ROWS * SERIES
    assert most(flags) < ROWS * SERIES / 4  # one task had all


def test_sweep_is_dealt_by_rows_and_equals_one_block(history, monkeypatch):
    kw = {"target_rows": ROWS * SERIES * len(sensors.SWEEP_ROLES)}  # one block and one task
    key = lambda r: (r["equipment_id"], r["role"], r["rule_id"])
    whole = sorted(sensors.sweep_evidence(history, **kw).collect(), key=key)
    monkeypatch.setattr(series, "BLOCK_BYTES", series.BLOCK_BYTES // 64)
    monkeypatch.setattr(series, "TASK_BYTES", series.TASK_BYTES // 64)
    flags = sensors.sweep_flags(history)
    assert most(flags) < ROWS * SERIES * len(sensors.SWEEP_ROLES) / 16
    cut = sorted(sensors.sweep_evidence(history).collect(), key=key)
    assert whole and [r.asDict() | {"fault_mean": None} for r in cut] == [r.asDict() | {"fault_mean": None} for r in whole]
    assert [r["fault_mean"] for r in cut] == pytest.approx([r["fault_mean"] for r in whole])


def test_wide_rows_make_smaller_blocks(spark):
    narrow, wide = spark.range(1), spark.range(1).select(*[F.lit(1.0).alias(f"c{i}") for i in range(100)])
    assert series.default_rows(wide) * series.row_bytes(wide) <= series.BLOCK_BYTES
    assert series.default_rows(wide) < series.default_rows(narrow) <= series.TARGET_ROWS
