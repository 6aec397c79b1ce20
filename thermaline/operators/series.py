"""Time-ordered work per series that does not depend on any one series fitting in a task.

`Window.partitionBy(equipment)` puts a whole series into one task. Here a series with more
than `target_rows` rows is cut into blocks made of whole time buckets. Each block also gets
the few neighbouring buckets its windows have to look at; rows of those neighbours are
marked `_core = False` and are dropped once the window columns exist. Series below the
limit stay in a single block and pay only for the count. The wider the rows, the fewer a
block holds. Where the number of rows is known, they are dealt to so many tasks that each
gets a few blocks; left alone, Spark packs as many into a task as compress to its advisory
size, and sorts them all at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from thermaline.functions.roles import ID

BUCKET_SECONDS = 86_400
TARGET_ROWS = 500_000
#: Bytes of rows, as they are sorted, of a block at most and of a task on average.
BLOCK_BYTES, TASK_BYTES = 16 << 20, 32 << 20
BLOCK, CORE, BUCKET = "_block", "_core", "_bucket"


def reach(bucket_seconds: int, before_seconds: float) -> int:
    """The bucket, lengthened to whole hours that hold the time look-back."""
    return max(bucket_seconds, 3600 * math.ceil(before_seconds / 3600))


def time_bucket(ts: str, seconds: int = BUCKET_SECONDS) -> Column:
    return F.expr(f"unix_micros({ts}) div {int(seconds) * 1_000_000}")


def block_map(df: DataFrame, keys, ts: str, *, before: int, after: int, before_seconds: float,
              bucket_seconds: int, target_rows: int) -> DataFrame:
    """(keys, bucket) -> (block, core) for the series that need cutting.

    One row per series and bucket, so its size follows calendar time, not row count. Two
    consecutive blocks together hold more than `target_rows` rows, hence a look-back of up
    to `target_rows` rows never reaches past the second neighbour.
    """
    if bucket_seconds % 3600:
        raise ValueError("buckets must be whole hours")
    # Blocks and buckets grow with the look-back, so any look-back is exact.
    target_rows = max(target_rows, before, after)
    bucket_seconds = reach(bucket_seconds, before_seconds)
    by_time = Window.partitionBy(*keys).orderBy(BUCKET)
    whole = Window.partitionBy(*keys)
    n = (df.groupBy(*keys, time_bucket(ts, bucket_seconds).alias(BUCKET))
           .agg(F.count(F.lit(1)).alias("_n")))
    n = (n.withColumns({
            "_total": F.sum("_n").over(whole),
            "_end": F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)),
            "_n_next": F.coalesce(F.lead("_n").over(by_time), F.lit(0)),
            "_n_prev": F.coalesce(F.lag("_n").over(by_time), F.lit(0)),
         })
         .where(F.col("_total") > F.lit(target_rows))
         .withColumn("_start", F.col("_end") - F.col("_n"))
         .withColumn("_cut", F.expr(f"_start div {int(target_rows)}"))
         .withColumn(BLOCK, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_cut"))))
    w = Window.partitionBy(*keys).orderBy(BLOCK)

    def at(step: int, c: Column) -> Column:
        return c.over(w.rangeBetween(step, step))

    n = n.withColumns({
        "_s1": at(1, F.min("_start")), "_s2": at(2, F.min("_start")), "_b1": at(1, F.min(BUCKET)),
        "_e1": at(-1, F.max("_end")), "_e2": at(-2, F.max("_end")),
    })
    # One spare bucket beyond the asked look-back, so that whole-hour groups and chained lags
    # are complete on every row that a core row can see.
    reach_fwd = F.col("_end") + F.col("_n_next")
    reach_back = F.col("_start") - F.col("_n_prev")
    near = F.lit(before_seconds > 0) & (F.col(BUCKET) >= F.col("_b1") - F.lit(2))

    def slot(cond: Column, step: int) -> Column:
        return F.when(cond, F.struct((F.col(BLOCK) + F.lit(step)).alias("b"), F.lit(False).alias("c")))

    slots = [F.struct(F.col(BLOCK).alias("b"), F.lit(True).alias("c"))]
    if before or before_seconds:
        slots.append(slot((reach_fwd > F.col("_s1") - F.lit(before)) | (F.col("_s1").isNotNull() & near), 1))
        slots.append(slot(reach_fwd > F.col("_s2") - F.lit(before), 2))
    if after:
        slots.append(slot(reach_back < F.col("_e1") + F.lit(after), -1))
        slots.append(slot(reach_back < F.col("_e2") + F.lit(after), -2))
    return (n.select(*keys, BUCKET, F.explode(F.array_compact(F.array(*slots))).alias("_s"))
             .select(*keys, BUCKET, F.col("_s.b").cast("long").alias(BLOCK), F.col("_s.c").alias(CORE)))


def split_series(df: DataFrame, keys=ID, ts: str = "timestamp_utc", *,
                 before: int = 0, after: int = 0, before_seconds: float = 0.0,
                 bucket_seconds: int = BUCKET_SECONDS,
                 target_rows: int | None = None, rows: int | None = None, dealt: bool = True) -> DataFrame:
    """Add `_block` and `_core`; see the module docstring.

    `before`/`after` are the rows a window may look back or ahead, `before_seconds` a time
    look-back, `rows` the number of rows of `df` if known; not `dealt`, the caller deals out the
    blocks. The join is a plain equi-join on (keys, bucket): Spark broadcasts the map
    when it is below the size threshold and shuffles both sides on a fine key otherwise.
    """
    keys = list(keys)
    target = int(target_rows or default_rows(df))
    if before or after or before_seconds:
        before = max(before, 1)
    m = block_map(df, keys, ts, before=before, after=after, before_seconds=before_seconds,
                  bucket_seconds=bucket_seconds, target_rows=target)
    out = df.withColumn(BUCKET, time_bucket(ts, reach(bucket_seconds, before_seconds)))
    out = deal(out, [*keys, BUCKET], rows, target).join(m, [*keys, BUCKET], "left")
    out = (out.withColumns({BLOCK: F.coalesce(F.col(BLOCK), F.lit(0).cast("long")),
                            CORE: F.coalesce(F.col(CORE), F.lit(True))})
              .drop(BUCKET))
    return deal(out, [*keys, BLOCK], rows, target) if dealt else out


def deal(df: DataFrame, keys, rows: int | None, target_rows: int) -> DataFrame:
    """`df` dealt by `keys` to tasks of a few blocks of `target_rows` rows; a number of rows that is small or not known is left to Spark."""
    parts = math.ceil((rows or 0) / (target_rows * (TASK_BYTES // BLOCK_BYTES)))
    return df if parts < 2 else df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def row_bytes(df: DataFrame) -> int:
    """About the bytes of a row while it is sorted: 8 a column, more for strings, and its place in the sort."""
    return 48 + sum(40 if kind == "string" else 8 for _, kind in df.dtypes)


def default_rows(df: DataFrame) -> int:
    by_width = min(TARGET_ROWS, max(1, BLOCK_BYTES // row_bytes(df)))
    return int(df.sparkSession.conf.get("thermaline.series.targetRows", str(by_width)))


def block_window(keys=ID, ts: str = "timestamp_utc", tiebreak=()) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(ts, *tiebreak)


def core_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(BLOCK, CORE)


def with_series_columns(df: DataFrame, make, keys=ID, ts: str = "timestamp_utc", *,
                        before: int = 0, after: int = 0, before_seconds: float = 0.0,
                        tiebreak=(), **kw) -> DataFrame:
    """Add window columns. `make(window)` returns a dict of columns, or a list of dicts
    applied in turn when a later column reads an earlier one."""
    s = split_series(df, keys, ts, before=before, after=after, before_seconds=before_seconds, **kw)
    w = block_window(keys, ts, tiebreak)
    steps = make(w)
    for step in steps if isinstance(steps, list) else [steps]:
        s = s.withColumns(step)
    return core_rows(s)


def _bucketed(df, keys, ts, seconds):
    return df.withColumn(BUCKET, time_bucket(ts, seconds)), list(keys)


def carry_forward(df: DataFrame, cols, keys=ID, ts: str = "timestamp_utc", *,
                  out=None, tiebreak=(), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Last non-null value at or before each row, however far back it lies.

    Inside a bucket this is a window; across buckets the carried value comes from a summary
    with one row per (keys, bucket).
    """
    return _carry(df, cols, keys, ts, out, tiebreak, bucket_seconds, forward=True)


def carry_backward(df: DataFrame, cols, keys=ID, ts: str = "timestamp_utc", *,
                   out=None, tiebreak=(), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Next non-null value at or after each row."""
    return _carry(df, cols, keys, ts, out, tiebreak, bucket_seconds, forward=False)


def _carry(df, cols, keys, ts, out, tiebreak, seconds, *, forward):
    b, keys = _bucketed(df, keys, ts, seconds)
    cols, names = list(cols), list(out or cols)
    tiebreak = [F.col(t) if isinstance(t, str) else t for t in tiebreak]
    pick = F.max_by if forward else F.min_by
    order = F.struct(F.col(ts).alias("t"), *[t.alias(f"k{i}") for i, t in enumerate(tiebreak)])
    summary = b.groupBy(*keys, BUCKET).agg(*[
        pick(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_c{i}") for i, c in enumerate(cols)])
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    if forward:
        across, fn = across.rowsBetween(Window.unboundedPreceding, -1), F.last
        inside = Window.partitionBy(*keys, BUCKET).orderBy(ts, *tiebreak).rowsBetween(
            Window.unboundedPreceding, 0)
    else:
        across, fn = across.rowsBetween(1, Window.unboundedFollowing), F.first
        inside = Window.partitionBy(*keys, BUCKET).orderBy(ts, *tiebreak).rowsBetween(
            0, Window.unboundedFollowing)
    summary = summary.select(*keys, BUCKET, *[
        fn(f"_c{i}", ignorenulls=True).over(across).alias(f"_p{i}") for i in range(len(cols))])
    joined = b.join(summary, [*keys, BUCKET], "left")
    return (joined.withColumns({n: F.coalesce(fn(F.col(c), ignorenulls=True).over(inside), F.col(f"_p{i}"))
                                for i, (c, n) in enumerate(zip(cols, names))})
                  .drop(BUCKET, *[f"_p{i}" for i in range(len(cols))]))


def ordinal(df: DataFrame, keys=ID, ts: str = "timestamp_utc", *, name: str = "_row",
            total: str | None = None, tiebreak=(), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """1-based row position within each series (and the series length), without sorting a
    whole series in one task: bucket offsets come from a running count over buckets."""
    b, keys = _bucketed(df, keys, ts, bucket_seconds)
    n = b.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    by_time = Window.partitionBy(*keys).orderBy(BUCKET)
    n = n.select(*keys, BUCKET,
                 (F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
                 .alias("_before"),
                 F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    w = Window.partitionBy(*keys, BUCKET).orderBy(ts, *tiebreak)
    j = b.join(n, [*keys, BUCKET]).withColumn(name, F.col("_before") + F.row_number().over(w))
    if total:
        j = j.withColumn(total, F.col("_total"))
    return j.drop(BUCKET, "_before", "_total")
