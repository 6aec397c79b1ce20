"""Live telemetry: envelopes to points, de-duplication, persistence, rolling rules, live
confirmation (X-1 to X-9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from thermaline.functions.roles import EQ, ID, SITE, TS
from thermaline.functions.roles import STRING_COLUMNS
from thermaline.sources.history import delete_tree, folders, forget_batch, live_files, replace_batch, snapshots

C = F.col

ENVELOPE = T.StructType([
    T.StructField("schema", T.StringType()), T.StructField("message_id", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("observed_at", T.TimestampType()),
    T.StructField("site_id", T.StringType()), T.StructField("edge_id", T.StringType()),
    T.StructField("protocol", T.StringType()), T.StructField("device_id", T.StringType()),
    T.StructField("points", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("unit", T.StringType()), T.StructField("quality", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])))])


def read_envelope_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(ENVELOPE)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(path)


def parse_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes carried as JSON text, as a message bus delivers them."""
    return raw.select(F.from_json(C(column).cast("string"), ENVELOPE).alias("e")).select("e.*")


def number_of(value: Column) -> Column:
    """Point values as numbers: true/false become 1/0."""
    v = F.lower(F.trim(value))
    return F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(v.try_cast("double"))


def envelope_points(env: DataFrame) -> DataFrame:
    """X-1: one row per tagged point. Only good and uncertain readings keep a value; a reading of
    bad quality stays as a NULL so its column is still seen."""
    p = env.select("message_id", "edge_id", "site_id", "observed_at", F.explode("points").alias("p"))
    tag = lambda k: F.try_element_at("p.tags", F.lit(k))
    ok = F.lower("p.quality").isin("good", "uncertain")
    return (p.select("message_id", "edge_id", "site_id", C("observed_at").alias(TS), tag("building_id").alias("building_id"),
                     tag(EQ).alias(EQ), tag("role").alias("role"), F.when(ok, C("p.value")).alias("text_value"),
                     F.when(ok, number_of(C("p.value"))).alias("value"), C("p.quality").alias("quality"))
             .where(C("building_id").isNotNull() & C(EQ).isNotNull() & C("role").isNotNull()))


def envelope_rows(env: DataFrame, roles) -> DataFrame:
    """X-1: one wide row per (envelope, equipment), built inside the envelope: no shuffle, so it
    is the same in batch and stream. `duplicate_role` marks envelopes that name a role twice."""
    tag = lambda p, k: F.try_element_at(p["tags"], F.lit(k))
    tagged = F.filter("points", lambda p: tag(p, "building_id").isNotNull() & tag(p, EQ).isNotNull() & tag(p, "role").isNotNull())
    ids = F.array_distinct(F.transform(tagged, lambda p: F.struct(tag(p, "building_id").alias("b"), tag(p, EQ).alias("e"))))
    e = env.withColumn("_pts", tagged).withColumn("_id", F.explode(ids))
    mine = F.filter("_pts", lambda p: (tag(p, "building_id") == C("_id.b")) & (tag(p, EQ) == C("_id.e")))
    e = e.withColumn("_mine", mine)
    names = F.transform("_mine", lambda p: tag(p, "role"))
    ok = lambda p: F.lower(p["quality"]).isin("good", "uncertain")

    def pick(role):
        hit = F.get(F.filter("_mine", lambda p: tag(p, "role") == F.lit(role)), F.lit(0))
        if role in STRING_COLUMNS:
            return F.when(ok(hit), hit["value"])
        return F.when(ok(hit), number_of(hit["value"]))

    return e.select("message_id", "edge_id", C("_id.b").alias("building_id"), C("_id.e").alias(EQ), C("observed_at").alias(TS),
                    (F.size(F.array_distinct(names)) < F.size(names)).alias("duplicate_role"),
                    *[pick(r).alias(r) for r in roles])


def drop_repeats(env: DataFrame, *, delay: str = "24 hours") -> DataFrame:
    """X-4: each (edge, message) once. In a stream the keys are kept for `delay`."""
    if env.isStreaming:
        return env.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["edge_id", "message_id"])
    return env.dropDuplicates(["edge_id", "message_id"])


def stream_name(checkpoint: str) -> str:
    """A folder name for the stream that owns a checkpoint."""
    return f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"


def fold_progress(counts: DataFrame, folder: str, batch_id: int, keys: list[str], merge: dict) -> None:
    """Snapshot `batch_id` of a stream's totals: the newest earlier snapshot merged with a batch's `counts`, one row per key. A
    replayed batch starts from the same earlier snapshot and writes the same rows, so nothing counts twice; maxima never fall."""
    spark = counts.sparkSession
    known = snapshots(spark, folder)
    before = [n for n in known if n < batch_id]
    if before:
        counts = spark.read.parquet(f"{folder}/{before[-1]}").select(counts.columns).union(counts)
    total = counts.groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()])
    total.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{batch_id}")
    for n in before[:-1]:
        delete_tree(spark, f"{folder}/{n}")


def progress(spark: SparkSession, root: str, kind: str = "rows") -> DataFrame | None:
    """X-3/X-4: what the streams into a tree have stored, from the last snapshot of each. `rows`: building_id, watermark (its newest
    stamp), rows, rejects. `repeats`: edge_id, messages, repeats (see `count_repeats`). None before the first batch."""
    last = [f"{root}/_progress/{kind}/{s}/{n[-1]}" for s in folders(spark, f"{root}/_progress/{kind}") if (n := snapshots(spark, f"{root}/_progress/{kind}/{s}"))]
    if not last:
        return None
    df = spark.read.parquet(*last)
    key = df.columns[0]
    return df.groupBy(key).agg(*[(F.max if c == "watermark" else F.sum)(c).alias(c) for c in df.columns[1:]])


def count_repeats(env: DataFrame, root: str, checkpoint: str, *, delay: str = "24 hours", every: str = "60 seconds", once: bool = False):
    """X-4: stored counts of distinct and repeated messages per edge, from the undropped stream of envelopes. A message is counted when
    the watermark has passed its hour by `delay`, the time for which `drop_repeats` knows it; the state is one counter per message."""
    n = (env.withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 hour"), "edge_id", "message_id").agg(F.count(F.lit(1)).alias("n")))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("edge_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(C("n") - 1).alias("repeats"))
        fold_progress(counts, f"{root}/_progress/repeats/{stream_name(checkpoint)}", batch_id, ["edge_id"], {"messages": F.sum, "repeats": F.sum})

    w = n.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def persist(rows: DataFrame, root: str, checkpoint: str, *, every: str = "60 seconds", once: bool = False):
    """X-2/X-3: append to the monthly tree that the batch writers use. The checkpoint is the progress
    marker; a replayed micro-batch replaces the files it wrote before. Rows of envelopes that name a
    role twice go to `<root>/rejects`, by batch. Marks and counts are kept by `fold_progress`, see `progress`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        bad = F.coalesce(C("duplicate_role"), F.lit(False)) | C(TS).isNull()
        batch.where(bad).write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
        replace_batch(batch.where(~bad).drop("message_id", "edge_id", "duplicate_role"), root, f"stream{batch_id}")
        counts = batch.groupBy(SITE).agg(F.max(F.when(~bad, C(TS))).alias("watermark"), F.count(F.when(~bad, 1)).alias("rows"), F.count(F.when(bad, 1)).alias("rejects"))
        fold_progress(counts, f"{root}/_progress/rows/{stream_name(checkpoint)}", batch_id, [SITE], {"watermark": F.max, "rows": F.sum, "rejects": F.sum})
        forget_batch(batch.sparkSession, root, f"stream{batch_id - 1}")  # the checkpoint is past it

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def telemetry_watermark(history: DataFrame) -> DataFrame:
    """X-3: newest persisted stamp per building. A progress marker, not a lateness bound."""
    return history.groupBy("building_id").agg(F.max(TS).alias("watermark"))


def rolling_window(history: DataFrame, *, hours: float = 24.0, lead_in_hours: float) -> DataFrame:
    """The last `hours` of each building up to its newest stamp, with a lead-in. `in_window` marks
    rows inside the window."""
    mark = telemetry_watermark(history)
    h = history.join(mark, "building_id")
    sec = lambda x: F.expr(f"INTERVAL {int(x * 3600)} SECONDS")
    return (h.where(C(TS) > C("watermark") - sec(hours + lead_in_hours))
             .withColumn("in_window", C(TS) > C("watermark") - sec(hours)).drop("watermark"))


def rolling_rules(history: DataFrame, rule_ids=None, *, weather: DataFrame | None = None, hours: float = 24.0,
                  poll: float = 300.0, params=None, **kw) -> DataFrame:
    """X-5/X-8: rules over the rolling window, by the same pass as in batch. The lead-in follows the
    rules' parameters; its samples confirm but do not count."""
    from thermaline.operators.runner import lead_in_rows, run_rules
    lead = lead_in_rows(rule_ids, poll=poll, params=params) * poll / 3600.0
    window = rolling_window(history, hours=hours, lead_in_hours=lead)
    return run_rules(window, rule_ids, weather=weather, poll=poll, params=params, counted=C("in_window"), **kw)


def rolling_afdd(rows: DataFrame, history_path: str, results_path: str, rule_ids, checkpoint: str, *, schema: T.StructType,
                 weather: DataFrame | None = None, hours: float = 24.0, poll: float = 300.0, params=None, once: bool = True):
    """X-5/X-7: after each micro-batch re-evaluate the window of the buildings that received data, late
    rows included, and replace their results. Only the months that a window can reach are read, and of each building the rows
    that its own window can reach. Without `weather`, rules that need it are skipped."""
    from thermaline.operators.runner import lead_in_rows
    reach = hours * 3600 + lead_in_rows(rule_ids, poll=poll, params=params) * poll

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(SITE).agg(F.max(TS).alias("_newest"))
        first = newest.agg(F.min("_newest")).first()[0]
        if first is None:
            return
        h = live_files(spark.read.schema(schema).parquet(history_path), spark, history_path.rpartition("/")[0])
        since = F.lit(first) - F.expr(f"INTERVAL {int(reach)} SECONDS")
        h = h.where((C(TS) > since) & (F.concat("year", "month") >= F.date_format(since, "yyyyMM")))
        # a building's persisted rows may be newer than those of the batch, so this only bounds what is read
        h = h.join(newest, SITE).where(C(TS) > C("_newest") - F.expr(f"INTERVAL {int(reach)} SECONDS")).drop("_newest")
        res = rolling_rules(h, rule_ids, weather=weather, hours=hours, poll=poll, params=params)
        (res.write.mode("overwrite").partitionBy(SITE).option("partitionOverwriteMode", "dynamic").parquet(results_path))

    w = rows.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="60 minutes")).start()


def latest_results(spark: SparkSession, results_path: str) -> DataFrame:
    """The newest evaluation of each building's rules."""
    return spark.read.parquet(results_path)


def backfill_chunks(spark: SparkSession, start: str, end: str, hours: int, *, pad_hours: float = 3.0) -> DataFrame:
    """X-6: bounded chunks with a lead-in for windows that reach back over a chunk start."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    step = F.expr(f"INTERVAL {int(hours)} HOURS")
    one = spark.range(1).select(F.explode(F.sequence(s, e - F.expr("INTERVAL 1 SECOND"), step)).alias("chunk_start"))
    return one.select("chunk_start", F.least(C("chunk_start") + step, e).alias("chunk_end"),
                      (C("chunk_start") - F.expr(f"INTERVAL {int(pad_hours * 3600)} SECONDS")).alias("read_from"))


# --- live confirmation (X-8) -----------------------------------------------------------------
CONFIRM_SCHEMA = T.StructType([
    T.StructField(SITE, T.StringType()), T.StructField(EQ, T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField(TS, T.TimestampType()),
    T.StructField("streak", T.LongType()), T.StructField("confirmed", T.BooleanType())])


class ConfirmProcessor(StatefulProcessor):
    """Streak length per (equipment, rule). Samples wait until the watermark has passed them, so
    they are counted in time order however they arrive."""

    def __init__(self, rows: int, horizon_ms: int = 0):
        self.rows, self.horizon_ms = rows, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", T.StructType([T.StructField("n", T.LongType())]))
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("ms", T.LongType())]),
                                          T.StructType([T.StructField("raw", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, raw in zip(pdf[TS], pdf["raw_fault"]):
                ms = int(pd.Timestamp(ts).value // 1_000_000)
                self.waiting.updateValue((ms,), (bool(raw),))
                self.handle.registerTimer(ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - 1
        if self.waiting.containsKey((due,)):
            raw = self.waiting.getValue((due,))[0]
            self.waiting.removeKey((due,))
            n = (self.streak.get()[0] if self.streak.exists() else 0) + 1 if raw else 0
            self.streak.update((n,))
            yield pd.DataFrame({SITE: [key[0]], EQ: [key[1]], "rule_id": [key[2]], TS: [pd.Timestamp(due, unit="ms")],
                                "streak": [n], "confirmed": [n >= self.rows]})

    def close(self) -> None:
        pass


def confirm_stream(flags: DataFrame, rows: int, *, delay: str = "10 minutes") -> DataFrame:
    """X-8: equipment_id, rule_id, timestamp_utc, raw_fault in; the online form of row
    confirmation out. Needs the RocksDB state store."""
    return (flags.withWatermark(TS, delay).groupBy(*ID, "rule_id")
            .transformWithStateInPandas(ConfirmProcessor(rows), outputStructType=CONFIRM_SCHEMA, outputMode="Append",
                                        timeMode="EventTime"))


# --- windowed aggregates on a stream (X-9) ---------------------------------------------------
def stream_means(rows: DataFrame, cols, *, seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    w = F.window(TS, f"{seconds} seconds")
    return (rows.withWatermark(TS, delay).groupBy(*ID, w.alias("w")).agg(*[F.avg(c).alias(c) for c in cols])
                .select(*ID, C("w.start").alias(TS), *cols))


def stream_hourly_counts(rows: DataFrame, flag: Column, *, delay: str = "10 minutes") -> DataFrame:
    """Tumbling hourly counts, as the operating-state rule needs them."""
    return (rows.withWatermark(TS, delay).groupBy(*ID, F.window(TS, "1 hour").alias("w"))
                .agg(F.count(F.when(flag, 1)).alias("n")).select(*ID, C("w.start").alias("clock_hour"), "n"))
