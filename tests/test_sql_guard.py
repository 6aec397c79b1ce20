"""User SQL: one query over the given views and nothing else."""

import pytest

from thermaline.sources import history as H


@pytest.fixture
def h(spark):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("secrets")
    spark.createDataFrame([(1,)], "x int").createOrReplaceGlobalTempView("shared_secrets")
    return spark.createDataFrame([("a--b", 1.0), ("x;'y", 2.0)], "equipment_id string, sat double")


@pytest.mark.parametrize("text", [
    "SELECT secrets.x FROM history, secrets", "SELECT * FROM history WHERE sat > (SELECT max(x) FROM secrets)", "SELECT * FROM global_temp.shared_secrets",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM history", "SELECT reflect('java.lang.Math', 'random')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "DROP VIEW history", "SELECT 1; SELECT 2", "SET spark.x = 1", "INSERT INTO history VALUES ('a', 1)",
    "WITH q AS (SELECT * FROM secrets) SELECT * FROM q", "SELECT * FROM range(10)", "SELECT input_file_name() FROM history"])
def test_refused(spark, h, text):
    with pytest.raises(ValueError):
        H.run_sql(spark, text, {"history": h}).collect()


@pytest.mark.parametrize(("text", "n"), [
    ("SELECT * FROM history WHERE equipment_id <> 'a--b'", 1), ("SELECT * FROM history WHERE equipment_id = 'x;''y'", 1),
    ("WITH q AS (SELECT * FROM history) SELECT * FROM q a JOIN q b ON a.sat = b.sat -- both", 2), ("SELECT 'drop table x', upper(equipment_id) FROM history", 2),
    ("SELECT count(*) FROM history h WHERE sat >= (SELECT avg(sat) FROM history)", 1), ("SELECT * FROM history WHERE sat > :least", 1)])
def test_allowed(spark, h, text, n):
    assert len(H.run_sql(spark, text, {"history": h}, {"least": 1.5} if ":least" in text else None).collect()) == n
