"""One Arrow pass per series and span of time (a week), with the few earlier rows that its windows look at.

Rows travel once, by (series, span). Each span leaves a tail: its last rows, as far back as a look-back may reach from the next one. The tails,
one row per series and span, are handed to the following span (over as many spans as it takes where they hold few rows), and the pass runs
on each span with its carried rows before it. No series has to fit in a task, and no row count has to be known beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: One pass holds at most a week of one series.
SPAN = 7 * 86_400_000_000
MINUTE = 60_000_000


@dataclass(frozen=True)
class Reach:
    """How far a pass looks back: `rows` and `seconds` from any row, and `held` seconds (and one row) that must be right themselves."""

    rows: int
    seconds: float = 0.0
    held: float = 0.0

    def start(self, t: np.ndarray) -> int:
        """The first row of sorted stamps `t` that a later row may depend on; negative when rows before `t` count too."""
        anchor = int(np.searchsorted(t, t[-1] - int(self.held * 1e6))) - 1
        if anchor < 0:
            return -1
        by_time = int(np.searchsorted(t, t[anchor] - int(self.seconds * 1e6))) - 1 if self.seconds else anchor
        return min(anchor - self.rows, by_time)


@dataclass
class Days:
    """What a pass is given: sorted stamps in microseconds and readings (nan: none), carried rows first; the first own row; the stamp
    of the next row of the series (None: there is none); the bits of `marks` that any row of the series has."""

    t: np.ndarray
    x: dict[str, np.ndarray]
    own: int
    next: int | None
    marks: int


def by_day(df: DataFrame, cols: list[str], reach: Reach, run: Callable[[pd.DataFrame, Days], pd.DataFrame], schema: str, *, keys, ts: str,
           marks: Column | None = None) -> DataFrame:
    """`run(own rows, days)` for every (series, span) of `df`, and what it returns, of type `schema`.

    Rows of equal stamps are ordered by their readings.
    """
    keys = list(keys)
    rows = df.withColumns({"_t": F.unix_micros(ts), "_mark": F.lit(0).cast("long") if marks is None else marks.cast("long")}).drop(ts)
    rows = rows.withColumn("_day", F.floor(F.col("_t") / F.lit(SPAN)).cast("long")).withColumns({c: F.col(c).cast("double") for c in cols})
    day = [*keys, "_day"]
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*day).schema.fields)

    def ordered(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values(["_t", *cols], kind="stable")

    def tail(part: pd.DataFrame) -> pd.DataFrame:
        part = ordered(part)
        t, start = part["_t"].to_numpy(), reach.start(part["_t"].to_numpy())
        some = part.iloc[max(start, 0):]
        x = np.stack([some[c].to_numpy(dtype=float) for c in cols]) if cols else np.zeros((0, len(some)))
        return part[day].iloc[:1].assign(first=t[0], whole=start >= 0, t=some["_t"].to_numpy().tobytes(), x=x.tobytes(),
                                         mark=int(np.bitwise_or.reduce(part["_mark"].to_numpy())))

    tails = rows.groupBy(*day).applyInPandas(tail, f"{head}, first long, whole boolean, t binary, x binary, mark long")
    by_time = Window.partitionBy(*keys).orderBy("_day")
    last = F.struct("t", "x")
    before = F.when(F.lag("whole").over(by_time), F.array(F.lag(last).over(by_time))).otherwise(
        F.collect_list(last).over(by_time.rowsBetween(-(reach.rows + 5), -1)))
    carried = tails.select(*day, before.alias("before"), F.lead("first").over(by_time).alias("next"),
                           F.bit_or("mark").over(Window.partitionBy(*keys)).alias("marks"))

    def pass_(part: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        part, info = ordered(part), info.iloc[0]
        old_t = [np.frombuffer(b["t"], np.int64) for b in info["before"]]
        old_x = [np.frombuffer(b["x"]).reshape(len(cols), -1) for b in info["before"]]
        t = np.concatenate([*old_t, part["_t"].to_numpy()])
        x = {c: np.concatenate([*[o[n] for o in old_x], part[c].to_numpy(dtype=float)]) for n, c in enumerate(cols)}
        return run(part, Days(t, x, len(t) - len(part), None if pd.isna(info["next"]) else int(info["next"]), int(info["marks"])))

    return rows.groupBy(*day).cogroup(carried.groupBy(*day)).applyInPandas(pass_, schema)


def nearest(t: np.ndarray, x: np.ndarray, target: np.ndarray, tolerance: int) -> np.ndarray:
    """The reading nearest to each target within the tolerance, of two equally near ones the later; of equal stamps the least reading.

    The last stamp at or before and the first after each target come from one merge of the two sorted lists.
    """
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    t, x = t[first], np.fmin.reduceat(x, first) if len(first) else x
    after = np.searchsorted(t, target, side="right")
    left, right = np.maximum(after - 1, 0), np.minimum(after, len(t) - 1)
    far_left = np.where(after > 0, target - t[left], np.iinfo(np.int64).max)
    far_right = np.where(after < len(t), t[right] - target, np.iinfo(np.int64).max)
    best = np.where(far_right <= far_left, right, left)
    return np.where(np.minimum(far_left, far_right) <= tolerance, x[best], np.nan)


def rolling_median(x: np.ndarray, rows: int, least: int) -> np.ndarray:
    """Median of the readings among the last `rows` rows, nan where fewer than `least` are there.

    A binary search tree over the ranks of all readings counts how many of the window lie in each subtree (a Fenwick tree): adding,
    removing and finding the middle reading take steps in the logarithm of the number of distinct readings.
    """
    known = ~np.isnan(x)
    values, rank = np.unique(x[known], return_inverse=True)
    place = np.zeros(len(x), dtype=int)
    place[known] = rank + 1
    size = len(values)
    top = 1 << max(size, 1).bit_length() - 1
    tree, out, held = [0] * (size + 1), np.full(len(x), np.nan), 0
    places, kept = place.tolist(), known.tolist()

    def add(i: int, by: int) -> None:
        while i <= size:
            tree[i] += by
            i += i & -i

    def nth(k: int) -> float:
        i, step = 0, top
        while step:
            if i + step <= size and tree[i + step] <= k:
                i += step
                k -= tree[i]
            step >>= 1
        return values[i]

    for n in range(len(x)):
        if kept[n]:
            add(places[n], 1)
            held += 1
        if n >= rows and kept[n - rows]:
            add(places[n - rows], -1)
            held -= 1
        if held >= least:
            out[n] = nth(held // 2) if held % 2 else (nth(held // 2 - 1) + nth(held // 2)) / 2
    return out
