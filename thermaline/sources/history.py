"""Reading, writing and maintaining the history table (S-1 to S-3, S-16 to S-26, S-30 to S-33)."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.logic import num
from thermaline.functions.roles import ALL_ROLES, NUMERIC_ROLES, history_schema
from thermaline.functions.scalars import with_scalars

C = F.col
PARTITIONS = ["building_id", EQ, "year", "month"]


# --- reading ---------------------------------------------------------------------------------
def read_history(spark: SparkSession, root: str, *, building: str | None = None, roles=None,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """S-1/S-2: `<root>/history/building_id=/equipment_id=/year=/month=`. The explicit schema
    makes absent roles NULL and keeps partition keys as text; scope filters prune directories."""
    df = live_files(spark.read.schema(history_schema(roles)).parquet(f"{root}/history"), spark, root)
    return scope(df, building=building, start=start, end=end)


def read_legacy(spark: SparkSession, root: str, *, roles=None) -> DataFrame:
    """The older layout, `building=<id>/equipment=<id>/history.parquet`: identity is in the path."""
    schema = T.StructType([f for f in history_schema(roles, partitioned=False).fields if f.name != EQ])
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(root)
    return with_path_identity(df)


def with_path_identity(df: DataFrame) -> DataFrame:
    path = C("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"building=([^/]+)/", 1).alias("building_id"),
                     F.regexp_extract(path, r"equipment=([^/]+)/", 1).alias(EQ))


def scope(df: DataFrame, *, building: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One building and a half-open time range. The range is also stated on the year and month
    keys, which the files' statistics alone could not prune before listing."""
    if building is not None:
        df = df.where(C("building_id") == building)
    ym = F.concat(C("year"), C("month")) if {"year", "month"} <= set(df.columns) else None
    for text, after in ((start, True), (end, False)):
        if text is None:
            continue
        t = F.lit(text).cast("timestamp")
        df = df.where(C(TS) >= t if after else C(TS) < t)
        if ym is not None:
            key = re.sub("-", "", text)[:6]
            df = df.where(ym >= key if after else ym <= key)
    return df


def weather_view(history: DataFrame) -> DataFrame:
    """Rows of weather stations inside the history table."""
    eq = C(EQ)
    return history.where(eq.ilike("%weather%") | eq.ilike("%meteo%") | eq.ilike("%oat%"))


def read_weather(spark: SparkSession, root: str, history: DataFrame | None = None) -> DataFrame | None:
    """S-3: the sidecar table if there is one, else weather rows of the history, else None."""
    try:
        return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{root}/weather")
    except AnalysisException:
        return None if history is None else weather_view(history)


# --- writing ---------------------------------------------------------------------------------
def with_partition_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.date_format(TS, "yyyy"), "month": F.date_format(TS, "MM")})


def write_history(df: DataFrame, root: str, *, mode: str = "append", max_rows_per_file: int = 2_000_000) -> None:
    """S-18: immutable monthly parts sorted by time. REBALANCE gathers a partition's rows into
    few files and lets AQE split a month of one busy equipment over several tasks."""
    out = with_partition_keys(df).hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, TS)
    (out.write.mode(mode).partitionBy(*PARTITIONS).option("compression", "snappy")
        .option("maxRecordsPerFile", max_rows_per_file).option("partitionOverwriteMode", "dynamic")
        .parquet(f"{root}/history"))


def historian_stats(spark: SparkSession, root: str, *, small_bytes: int = 16 << 20) -> DataFrame:
    """S-21: files, bytes, rows and small files per partition, from file metadata."""
    df = spark.read.schema(history_schema([])).parquet(f"{root}/history")
    df = live_files(df.select(*PARTITIONS, C("_metadata.file_path").alias("file"), C("_metadata.file_size").alias("bytes"), "_metadata"), spark, root)
    files = df.groupBy(*PARTITIONS, "file", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    return files.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.count(F.when(C("bytes") < small_bytes, 1)).alias("small_files"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def delete_tree(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the completely written snapshots in a folder, in order."""
    fs, _ = _fs(spark, path)
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n) for n in folders(spark, path) if n.isdigit() and done(n))


def _publish(spark: SparkSession, staged: str, root: str, prefix: str) -> None:
    """Move the staged files into the tree under names that start with `prefix`."""
    fs, _ = _fs(spark, staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for f in _staged_files(spark, staged):
        source, target = path(f"{staged}/{f}"), path(f"{root}/history/{_named(f, prefix)}")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")


def _staged_files(spark: SparkSession, staged: str) -> list[str]:
    """The data files under a folder, relative to it."""
    fs, top = _fs(spark, staged)
    files, found = fs.listFiles(top, True), []
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().startswith("part-"):
            found.append(f.toUri().getPath()[len(top.toUri().getPath()):].lstrip("/"))
    return found


def _named(file: str, prefix: str) -> str:
    folder, _, name = file.rpartition("/")
    return f"{folder}/{prefix}-{name}"


def _stage(df: DataFrame, root: str, name: str) -> str:
    """A written copy beside the data, by partition; the rewrite must not read what it replaces."""
    path = f"{root}/_staging/{name}"
    df.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, TS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)
    return path


# --- small files that are committed by one rename ------------------------------------------------
def _read_json(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit_json(spark: SparkSession, value, path: str, *, replace: bool = False) -> bool:
    """Write the value beside `path` and rename it there; False if the path is taken already."""
    temp = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    fs, t = _fs(spark, temp)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(t.getParent())
    out = fs.create(t, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if replace:
        fs.delete(p, False)
    done = not fs.exists(p) and fs.rename(t, p)
    if not done:
        fs.delete(t, False)
    return done


# --- versions (S-19, S-22) -----------------------------------------------------------------------
class Conflict(RuntimeError):
    """Another rewrite has replaced a file that this one has read."""


def _versions(spark: SparkSession, root: str) -> tuple[int, list[str], list[str]]:
    """(last version, ids of the committed rewrites, ids of those whose replaced files are still there).

    `<root>/_versions/<n>.json` holds all of it as of version n, so one small file is read.
    """
    fs, p = _fs(spark, f"{root}/_versions")
    if not fs.exists(p):
        return 0, [], []
    last = max((int(m.group(1)) for f in fs.listStatus(p) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName()))), default=0)
    now = _read_json(spark, f"{root}/_versions/{last}.json") if last else None
    return (last, now["committed"], now["pending"]) if now else (0, [], [])


_REWRITTEN = r"^v([0-9a-f]{32})-"


def _place() -> Column:
    """A file's path inside the tree, as the file metadata spell it."""
    return F.regexp_extract("_metadata.file_path", r"/history/(.*)$", 1)


def live_files(df: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The rows of the files that belong to the newest version: those of a rewrite from its commit on, and those it replaces until then.

    The first condition only looks at file names, so files are left out before they are opened.
    """
    _, committed, pending = _versions(spark, root)
    by = F.regexp_extract("_metadata.file_name", _REWRITTEN, 1)
    df = df.where((by == "") | by.isin(committed) if committed else by == "")
    if not pending:
        return df
    gone = spark.read.schema("file string").parquet(*[f"{root}/_versions/replaced-{i}" for i in pending])
    columns = df.columns
    return df.withColumn("_place", _place()).join(gone.select(C("file").alias("_place")), "_place", "left_anti").select(*columns)


def _rewrite(spark: SparkSession, df: DataFrame, files: DataFrame, root: str) -> None:
    """Replace exactly the files that were read by `df`; rows appended meanwhile are in other files and stay. `files`: one column
    `file`, places inside the tree.

    New files carry the rewrite's id and are not read before its commit, a single rename of a small file that names the rewrite and the list of
    what it replaces. A reader sees all of the old files or all of the new ones, and a crash at any point leaves no row twice.
    """
    name = uuid.uuid4().hex
    listed = f"{root}/_versions/replaced-{name}"
    files.select("file").write.parquet(listed)
    staged = _stage(df, root, name)
    _publish(spark, staged, root, f"v{name}")
    mine = spark.read.schema("file string").parquet(listed)
    while True:
        last, committed, pending = _versions(spark, root)
        since = spark.read.schema("file string").parquet(*[f"{root}/_versions/replaced-{i}" for i in pending]) if pending else None
        if since is not None and not mine.join(since, "file", "left_semi").isEmpty():
            raise Conflict("files were replaced by another rewrite meanwhile; nothing was changed")
        if _commit_json(spark, {"committed": [*committed, name], "pending": [*pending, name]}, f"{root}/_versions/{last + 1}.json"):
            break
    _delete(spark, staged)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the files that committed rewrites have replaced, and what unfinished rewrites have left. Returns the number of files.

    To be run when no reader of an older version and no rewrite is at work.
    """
    last, committed, pending = _versions(spark, root)
    jvm, n = spark._jvm, 0
    if pending:
        gone = spark.read.schema("file string").parquet(*[f"{root}/_versions/replaced-{i}" for i in pending]).distinct()
        for row in gone.toLocalIterator():
            fs, p = _fs(spark, f"{root}/history/{jvm.java.net.URI(row['file']).getPath()}")
            n += bool(fs.delete(p, False))
    names = spark.read.schema(history_schema([])).parquet(f"{root}/history").select("_metadata.file_path", "_metadata.file_name").distinct()
    by = F.regexp_extract("file_name", _REWRITTEN, 1)
    dead = names.where((by != "") & ~(by.isin(committed) if committed else F.lit(False)))
    for row in dead.toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["file_path"]))
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False))
    if pending:
        _commit_json(spark, {"committed": committed, "pending": []}, f"{root}/_versions/{last + 1}.json")
        for i in pending:
            _delete(spark, f"{root}/_versions/replaced-{i}")
        for k in range(1, last + 1):
            _delete(spark, f"{root}/_versions/{k}.json")
    _delete(spark, f"{root}/_staging")
    return n


# --- batches of a stream (X-2) -------------------------------------------------------------------
def replace_batch(df: DataFrame, root: str, batch: str) -> None:
    """Put a batch's rows into the tree; what an earlier try of the same batch has put there goes first.

    `<root>/_ledger/<batch>.json` names the files before the first of them is moved, so a replay deletes by name and never lists the tree.
    """
    spark = df.sparkSession
    ledger = f"{root}/_ledger/{batch}.json"
    for f in _read_json(spark, ledger) or []:
        _delete(spark, f"{root}/history/{f}")
    staged = _stage(with_partition_keys(df), root, batch)
    _commit_json(spark, [_named(f, batch) for f in _staged_files(spark, staged)], ledger, replace=True)
    _publish(spark, staged, root, batch)
    _delete(spark, staged)


def forget_batch(spark: SparkSession, root: str, batch: str) -> None:
    """Drop the ledger of a batch that can't be replayed any more."""
    _delete(spark, f"{root}/_ledger/{batch}.json")


def _with_file(spark: SparkSession, root: str, roles) -> DataFrame:
    return live_files(spark.read.schema(history_schema(roles)).parquet(f"{root}/history").withColumn("_file", _place()), spark, root)


def compact(spark: SparkSession, root: str, *, min_files: int = 8, building: str | None = None, roles=None) -> DataFrame:
    """S-19: rewrite the partitions made of many small files. Returns what was rewritten."""
    stats = historian_stats(spark, root).where(C("small_files") >= min_files)
    stats = stats if building is None else stats.where(C(SITE) == building)
    todo = f"{root}/_staging/{uuid.uuid4().hex}-partitions"
    stats.write.parquet(todo)  # also fixes what is rewritten, whatever is appended meanwhile
    todo = spark.read.parquet(todo)
    if todo.isEmpty():
        return todo
    rows = _with_file(spark, root, roles).join(todo.select(*PARTITIONS), PARTITIONS, "left_semi")
    fixed = f"{root}/_staging/{uuid.uuid4().hex}-fixed"
    rows.select(C("_file").alias("file")).distinct().write.parquet(fixed)
    files = spark.read.parquet(fixed)
    _rewrite(spark, rows.join(files, C("_file") == C("file"), "left_semi").drop("_file"), files, root)
    return todo


def migrate_legacy(spark: SparkSession, legacy_root: str, root: str, *, dry_run: bool = True, roles=None) -> DataFrame:
    """S-20: older Parquet, JSON lines and Arrow files into the canonical layout. Only path identity is trusted (`legacy.discover`
    names the files without it); rows without a stamp are reported and left alone."""
    from thermaline.sources.legacy import read_mixed
    df = read_mixed(spark, legacy_root, roles=roles)
    ok = C(TS).isNotNull()
    report = df.groupBy("building_id", EQ).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(ok, 1)).alias("migrated"))
    if not dry_run:
        write_history(df.where(ok), root)
    return report


def purge_filter(*, building=None, equipment=None, before=None, after=None) -> Column:
    cond = F.lit(True)
    if building is not None:
        cond = cond & (C("building_id") == building)
    if equipment is not None:
        cond = cond & C(EQ).isin(list(equipment))
    if before is not None:
        cond = cond & (C(TS) < F.lit(before).cast("timestamp"))
    if after is not None:
        cond = cond & (C(TS) >= F.lit(after).cast("timestamp"))
    return cond


def purge_preview(spark: SparkSession, root: str, **flt) -> DataFrame:
    """S-22: rows that would go, per partition, and whether the partition would be empty."""
    df = live_files(spark.read.schema(history_schema([])).parquet(f"{root}/history"), spark, root)
    hit = F.count(F.when(purge_filter(**flt), 1))
    return (df.groupBy(*PARTITIONS).agg(hit.alias("rows_purged"), (F.count(F.lit(1)) - hit).alias("rows_kept"))
              .where(C("rows_purged") > 0))


def purge(spark: SparkSession, root: str, *, roles=None, **flt) -> int:
    """S-22: rewrite the affected partitions without the rows; drop those left empty."""
    if not any(v is not None for v in flt.values()):
        raise ValueError("purge needs at least one filter")
    hit = purge_filter(**flt)
    rows = _with_file(spark, root, roles)
    fixed = f"{root}/_staging/{uuid.uuid4().hex}-fixed"
    rows.where(hit).groupBy(C("_file").alias("file")).agg(F.count(F.lit(1)).alias("n")).write.parquet(fixed)
    files = spark.read.parquet(fixed)
    gone = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if gone:
        kept = rows.join(files, C("_file") == C("file"), "left_semi").where(~hit).drop("_file")
        _rewrite(spark, kept, files.select("file"), root)
    return gone


# --- export, paging, SQL ---------------------------------------------------------------------
def export_rows(df: DataFrame, roles, *, tz: str = "UTC") -> DataFrame:
    """S-23: long form with UTC and local time as text."""
    from thermaline.operators.align import wide_to_long
    long = wide_to_long(df, roles)
    f = "yyyy-MM-dd'T'HH:mm:ss"
    return long.select(*ID, F.date_format(TS, f).alias("timestamp_utc"),
                       F.date_format(F.from_utc_timestamp(TS, tz), f).alias("timestamp_local"), "role", "value")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_faults(results: DataFrame, path: str, *, summary: bool = False) -> None:
    """S-24."""
    out = results.groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("fault_hours").alias("fault_hours")) \
        if summary else results
    export_csv(out, path)


def page(df: DataFrame, order, *, limit: int, offset: int = 0) -> DataFrame:
    """S-25: a page of ordered rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


class TooManyRows(ValueError):
    pass


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """S-25: refuse a result larger than `rows`; the probe stops at rows + 1."""
    probe = df.limit(rows + 1)
    if probe.count() > rows:
        raise TooManyRows(f"more than {rows} rows")
    return probe


#: Functions that reach outside the data; every other one Spark ships works on its arguments only.
OUTSIDE = ("CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "PythonUDF", "ScalaUDF",
           "HiveGenericUDF", "HiveSimpleUDF", "CurrentUser", "CurrentDatabase", "CurrentCatalog")


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _check_plan(plan, allowed: set[str]) -> None:
    """Walk an analyzed plan, subqueries included: each relation is one of the given views, whose own plans are not entered, and no
    expression reaches outside."""
    def outside(e) -> None:
        if e.getClass().getSimpleName() in OUTSIDE:
            raise ValueError(f"function not allowed: {e.prettyName()}")
        for child in _items(e.children()):
            outside(child)

    kind = plan.getClass().getSimpleName()
    if kind == "SubqueryAlias" and plan.child().getClass().getSimpleName() == "View":
        if plan.identifier().qualifier().size() or plan.identifier().name().lower() not in allowed:
            raise ValueError(f"unknown table: {plan.identifier().toString()}")
        return
    if kind == "Range" or not plan.children().size() and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
        raise ValueError(f"relation not allowed: {kind}")
    for e in _items(plan.expressions()):
        outside(e)
    for part in [*_items(plan.children()), *_items(plan.subqueries())]:
        _check_plan(part, allowed)


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """S-26: a user SELECT over the given views, in a session of its own. Spark parses the text, as a query only, and the analyzed
    plan must read nothing but the views and call nothing that reaches outside."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
    except Exception as error:  # the parser's own message says what isn't a query
        raise ValueError(f"only a single SELECT is allowed: {str(error).splitlines()[0]}") from None
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    try:
        out = own.sql(text, args or {})
    except AnalysisException as error:
        raise ValueError(f"unknown table, column or function: {str(error).splitlines()[0]}") from None
    _check_plan(out._jdf.queryExecution().analyzed(), {n.lower() for n in tables})
    return out


def read_jdbc(spark: SparkSession, url: str, *, query: str | None = None, table: str | None = None, limit: int | None = None,
              partition_column: str | None = None, lower=None, upper=None, partitions: int = 16, **options) -> DataFrame:
    """S-30: a read-only query or table, split on a numeric or time column when one is given."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    if query is not None and not re.match(r"(?is)^\s*(select|with)\b", query):
        raise ValueError("only SELECT is allowed")
    source = f"({query.strip().rstrip(';')}) q" if query else table
    r = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
              .option("upperBound", str(upper)).option("numPartitions", str(partitions)))
    df = r.load()
    return df.limit(limit) if limit else df


# --- checks ----------------------------------------------------------------------------------
def validate_building(history: DataFrame, mapped: DataFrame, *, required=("fan_cmd",)) -> DataFrame:
    """S-16: per mapped equipment its rows, roles and errors. `mapped`: equipment_id, role."""
    roles = mapped.groupBy(*ID).agg(F.collect_set("role").alias("roles"))
    rows = history.groupBy(*ID).agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
    j = roles.join(rows, list(ID), "full_outer").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    lacking = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("roles", F.array().cast("array<string>")))
    return j.select(*ID, "rows", F.coalesce(F.size("roles"), F.lit(0)).alias("role_count"), F.array_sort(lacking).alias("missing"),
                    F.when(C("rows") == 0, "error: no history").when(C("roles").isNull(), "error: no role map")
                     .when(F.size(lacking) > 0, "warning: missing roles").otherwise("ok").alias("verdict"))


def ingest_quality_gate(df: DataFrame, *, ts: str = TS, value: str = "value", keys=ID, strict: bool = True) -> DataFrame:
    """S-17: one row per check over an import: count of offenders and whether it blocks."""
    dup = df.where(C(ts).isNotNull()).groupBy(*keys, ts).agg((F.count(F.lit(1)) - 1).alias("_d")).agg(
        F.coalesce(F.sum("_d"), F.lit(0).cast("long")).alias("n")).select(F.lit("duplicate_timestamp").alias("check"), "n")
    wide = df.agg(F.count(F.when(C(ts).isNull(), 1)).alias("bad_timestamp"), F.count(F.when(C(value).isNull(), 1)).alias("empty_value"),
                  F.count(F.when(F.isnan(C(value)) | (F.abs(C(value)) == F.lit(float("inf"))), 1)).alias("not_finite"),
                  F.count(F.when(reduce(lambda a, b: a | b, [C(k).isNull() | (F.trim(C(k)) == "") for k in keys]), 1)).alias("no_identity"))
    n = wide.unpivot([], list(wide.columns), "check", "n").unionByName(dup)
    hard = ["bad_timestamp", "no_identity"] + (["duplicate_timestamp", "not_finite"] if strict else [])
    return n.withColumn("blocks", (C("n") > 0) & C("check").isin(hard))


def audit_package(history: DataFrame, mapped: DataFrame, *, trusted_start: str, feeds: DataFrame | None = None) -> DataFrame:
    """S-31: mapped but absent columns, data before the trusted start (warning only), VAV to AHU
    coverage, and a grade per building package: incomplete / degraded / ok, as one row."""
    absent = mapped.where(~C("role").isin(history.columns)).agg(F.count(F.lit(1)).alias("absent_roles"))
    span = history.agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
                       F.count(F.when(C(TS) < F.lit(trusted_start).cast("timestamp"), 1)).alias("before_trusted"))
    out = with_scalars(absent, span)
    vavs = history.where(F.upper(EQ).startswith("VAV")).select(*ID).distinct()
    if feeds is not None:
        known = history.select(SITE, C(EQ).alias("parent_ahu")).distinct().withColumn("_k", F.lit(1))
        f = vavs.join(feeds.select(*ID, "parent_ahu"), list(ID), "left").join(known, [SITE, "parent_ahu"], "left")
        cover = f.agg((num(100) * F.count("_k") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("feed_coverage_pct"),
                      F.count(F.when(C("parent_ahu").isNull(), 1)).alias("vavs_without_ahu"))
        stale = feeds.select(*ID).distinct().join(history.select(*ID).distinct(), list(ID), "left_anti").agg(
            F.count(F.lit(1)).alias("stale_feeds"))
        out = with_scalars(with_scalars(out, cover), stale)
    else:
        out = out.select("*", num(100).alias("feed_coverage_pct"), F.lit(0).alias("vavs_without_ahu"), F.lit(0).alias("stale_feeds"))
    bad = (C("absent_roles") > 0) | (C("feed_coverage_pct") < num(50))
    soft = (C("before_trusted") > 0) | (C("vavs_without_ahu") > 0) | (C("stale_feeds") > 0)
    return out.withColumn("grade", F.when(bad, "incomplete").when(soft, "degraded").otherwise("ok"))


# --- imported rows ---------------------------------------------------------------------------
def with_lineage(df: DataFrame, raw_ts: str, parsed: Column) -> DataFrame:
    """S-32: source file, position within the read, raw stamp and parse status on each row.
    The position orders rows within a file split; it is not a line number."""
    return df.select("*", C("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("source_position"),
                     C(raw_ts).alias("raw_timestamp"), F.when(parsed.isNull(), "failed").otherwise("ok").alias("parse_status"),
                     F.lit(False).alias("fill_created"))


def rows_to_dataset(long: DataFrame, root: str, *, building: str, roles=None) -> DataFrame:
    """S-33: imported long rows into the history tree; returns the inferred grid per equipment."""
    from thermaline.operators.align import interval_mode, long_to_wide
    wide = long_to_wide(long.where(C(TS).isNotNull()), roles or NUMERIC_ROLES).withColumn("building_id", F.lit(building))
    write_history(wide, root)
    return interval_mode(wide).select(*ID, (C("interval_s") / num(60)).alias("grid_minutes"))


KNOWN_ROLES = ALL_ROLES
