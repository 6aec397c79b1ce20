"""Wide and long CSV packages into role-named history (S-4, S-5, S-9).

A package holds `<equipment>/history_wide.csv` and `<equipment>/columns.csv` (col, point_role).
All files are read as one text source: each record is matched to its file's header, the first record, by a join,
so a package with many equipment folders is still a single job, and nothing runs while planning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from thermaline.functions.roles import STRING_COLUMNS, role_type
from thermaline.operators.topology import canonical_role, column_score
from thermaline.sources.lines import reason, records

C = F.col
EQ, TS = "equipment_id", "timestamp_utc"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(c: Column) -> Column:
    """Only stamps that carry an offset are accepted."""
    t = F.trim(c)
    return F.when(t.rlike(RFC3339), F.upper(t).try_cast("timestamp"))


def cell_number(c: Column) -> Column:
    """Numbers, and yes/no words as 1 and 0; other text is NULL."""
    t = F.lower(F.trim(c))
    x = t.try_cast("double")
    return (F.when(t.isin("true", "yes", "on"), F.lit(1.0)).when(t.isin("false", "no", "off"), F.lit(0.0))
             .when(~F.isnan(x), x))


def equipment_of(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -2))


def read_role_map(spark: SparkSession, root: str, *, name: str = "columns.csv") -> DataFrame:
    """equipment_id, column, role for every mapped column; the best column per role stays."""
    raw = spark.read.option("header", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).csv(root)
    col = "column" if "column" in raw.columns else "col"
    role = "point_role" if "point_role" in raw.columns else "role"
    m = raw.select(equipment_of(C("_metadata.file_path")).alias(EQ), F.trim(col).alias("column"),
                   canonical_role(C(role)).alias("role")).where((C("column") != "") & (C("role") != ""))
    w = Window.partitionBy(EQ, "role").orderBy(F.desc(column_score(C("role"), C("column"))), "column")
    return m.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_wide_rows(spark: SparkSession, root: str, roles, *, name: str = "history_wide.csv", role_map: DataFrame | None = None,
                   stamp: str = TS) -> DataFrame:
    """S-15/S-32: every record of a package with equipment_id, timestamp_utc, one column per role, and its lineage: source_file,
    source_row_number, raw_timestamp, parse_status (ok, or the reason it is set aside), the line itself and fill_created."""
    role_map = read_role_map(spark, root) if role_map is None else role_map
    rows = records(spark, root, name=name).withColumn(EQ, equipment_of(C("source_file")))
    heads = rows.select("source_file", EQ, "names").distinct()  # one row per file
    named = heads.select("source_file", EQ, F.posexplode("names").alias("pos", "column")).join(
        role_map.select(EQ, "column", "role"), [EQ, "column"], "left")
    named = named.withColumn("role", F.when(F.lower("column") == stamp, F.lit(stamp)).otherwise(C("role"))).where(C("role").isNotNull())
    first = named.groupBy("source_file", "role").agg(F.min("pos").alias("pos"))
    index = first.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("role", "pos"))).alias("_at"))  # one header
    body = rows.join(index, "source_file", "left")
    at = lambda r: F.get("cells", F.try_element_at("_at", F.lit(r)))
    out = [rfc3339(at(stamp)).alias(TS)]
    for r in roles:
        v = at(r)
        out.append((F.when(v != "", v) if r in STRING_COLUMNS else cell_number(v)).cast(role_type(r)).alias(r))
    return body.select(EQ, *out, "source_file", "source_row_number", at(stamp).alias("raw_timestamp"),
                       reason(at(stamp), rfc3339(at(stamp))).alias("parse_status"), "line", F.lit(False).alias("fill_created"))


def read_wide_csv(spark: SparkSession, root: str, roles, *, name: str = "history_wide.csv", role_map: DataFrame | None = None,
                  stamp: str = TS) -> DataFrame:
    """S-4: equipment_id, timestamp_utc and one column per role of the records whose status is ok."""
    rows = read_wide_rows(spark, root, roles, name=name, role_map=role_map, stamp=stamp)
    return rows.where("parse_status = 'ok'").select(EQ, TS, *roles)


def quarantine(rows: DataFrame) -> DataFrame:
    """S-15: the records of `read_wide_rows` that are set aside, with their place, line and reason."""
    return rows.where("parse_status <> 'ok'").select("source_file", "source_row_number", EQ, "raw_timestamp", "line", C("parse_status").alias("reason"))


def ingest_wide_csv(spark: SparkSession, root: str, out: str, roles, *, building: str, metric: bool = False) -> DataFrame:
    """S-4: read, convert units if asked, and append to the history tree."""
    from thermaline.functions.roles import metric_to_imperial
    from thermaline.sources.history import write_history
    df = read_wide_csv(spark, root, roles).withColumn("building_id", F.lit(building))
    df = metric_to_imperial(df) if metric else df
    write_history(df, out)
    return df


def ingest_weather(spark: SparkSession, root: str, out: str, roles) -> DataFrame:
    """S-5: weather files into the sidecar table."""
    df = read_wide_csv(spark, root, roles)
    df.write.mode("append").parquet(f"{out}/weather")
    return df


def read_long_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long telemetry (ts, site, point_role, value, ...) with canonical roles; malformed lines
    are kept aside in `_corrupt`."""
    schema = ("site string, serving_ahu string, point_role string, point_name string, kind string, unit string, "
              "value string, status string, ts string, _corrupt string")
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").csv(path))
    return raw.select(C("serving_ahu").alias(EQ), "site", canonical_role(C("point_role")).alias("role"), "unit", "status",
                      cell_number(C("value")).alias("value"), rfc3339(C("ts")).alias(TS), C("ts").alias("raw_timestamp"), "_corrupt")
