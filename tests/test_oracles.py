"""A cross-section of the registered queries against DuckDB on the smallest driver tables."""

import datetime as dt
import math
import os

import pytest

from conftest import SF

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

import __spark_entry__ as entry  # noqa: E402

SAMPLE = ["rule_fc1", "rule_vav_1", "rule_chw_noload_1", "confirm_elapsed", "confirm_episodes", "join_asof_previous", "join_floor_hour",
          "fill_linear", "append_merge", "localize_dst", "operating_state", "hunting_by_output", "infer_parent", "runtime_hours",
          "sensor_health", "oat_bins", "zone_comfort_rank", "timeseries_thinned", "psychrometrics", "fuel_annual_gas_share", "fuel_quality",
          "measure_savings", "fault_intervals", "fault_lifecycle", "fault_lifecycle_summary", "csv_quarantine", "suggest_columns", "suggest_unmapped"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def test_registry_and_oracles_line_up():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    ix = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in ix) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_needs_no_session():
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
