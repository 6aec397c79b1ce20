"""Centroid clustering in whole numbers, with Ptolemaic pivots.

For a vector x, a centroid c and two pivots p and s, Ptolemy's inequality gives d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|.
The distances of the vectors to the pivots are computed once and stored beside them; each round adds those of the centroids. A centroid is
left out for a vector when its bound, rounded down by more than the error of the doubles it is computed in, is above the exact distance to
the centroid of least bound. All others are checked exactly in 64-bit integers, so the result is that of plain assignment.

Kept are vectors of exactly `dims` components, none null or non-finite. Component x becomes floor(256 * x); beyond 2^27 in magnitude it is
cut to that, as squared distances would not fit a long. The first centroids are the `k` kept vectors whose text `<salt>:<id>` has the
smallest SHA-256 (equal ids: the lesser vector first; null ids last); with fewer than `k` kept vectors all of them start. Rounds and sums
are exact: sums leave each task as longs, meet as decimals and are floored. Repeated rows are vectors each. An empty table gives no
rows; other columns are ignored. A total beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import staged

K, ROUNDS, DIMS, SALT = 40, 5, 64, "2"
#: Pivots, taken from the first centroids one by one as far from those before as possible.
PIVOTS = 8
#: Largest magnitude of a component.
LIMIT = 2**27
#: Relative error that the doubles of a bound stay well under.
ERROR = 2.0**-49


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int = 256) -> DataFrame:
    """id and the integer components v of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), e * F.lit(float(scale))))).cast("int"))
    good = (F.size(x) == dims) & ~F.coalesce(bad, F.lit(True))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b, pair by pair."""
    diff = a - b
    return np.einsum("...j,...j->...", diff, diff)


def choose_pivots(start: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n distinct rows of `start`, each the farthest from those chosen before."""
    chosen, far = [0], squared(start, start[0])
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(start, start[chosen[-1]]))
    return start[chosen]


class Assigner:
    """Nearest centroids by pivot bounds: `centroids` and `pivots` are integer rows."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.c = centroids
        to = np.sqrt(squared(centroids[:, None, :], pivots[None, :, :]).astype(np.float64))
        self.pairs = []
        for i in range(len(pivots)):
            for j in range(i):
                between = np.sqrt(float(squared(pivots[i], pivots[j])))
                self.pairs.append((i, j, to[:, i], to[:, j], between * (1 + ERROR)))

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """A number that is never above the squared distance of each row to each centroid; cached: its squared pivot distances."""
        d = np.sqrt(cached.astype(np.float64))
        best = np.zeros((len(d), len(self.c)))
        for i, j, ci, cj, between in self.pairs:
            one, two = d[:, i, None] * cj, d[:, j, None] * ci
            np.maximum(best, (np.abs(one - two) - (one + two) * ERROR) / between, out=best)
        return best * best * (1 - ERROR)

    def nearest(self, v: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, exact squared distance) of each row, equal distances to the smaller number; and the number of exact checks."""
        low = self.bounds(cached)
        guess = low.argmin(axis=1)
        best = squared(v, self.c[guess])
        # a double is below its rounded-up upper bound, so nothing at most as far as `best` is left out
        row, col = np.nonzero(low <= (best.astype(np.float64) * (1 + ERROR))[:, None])
        exact = np.concatenate([squared(v[row[at:at + 65536]], self.c[col[at:at + 65536]]) for at in range(0, len(row), 65536)])
        first = np.searchsorted(row, np.arange(len(v)))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        own = hit[np.unique(row[hit], return_index=True)[1]]
        return col[own], least, len(row)


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(batch["v"].to_numpy()).astype(np.int64), np.stack(batch["cached"].to_numpy()).astype(np.int64)


def _bigint(total):
    """A decimal sum as a long, null if it doesn't fit."""
    return F.when(F.abs(total) <= F.lit(2**63 - 1), total.cast("long"))


def assigned(rows: DataFrame, assigner: Assigner) -> DataFrame:
    """id, cluster and squared distance of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.iloc[lo:lo + 4096]
                cluster, far, _ = assigner.nearest(*_arrays(part))
                yield pd.DataFrame({"id": part["id"].array, "cluster": cluster.astype(np.int32), "distance": far})

    return rows.mapInPandas(run, "id long, cluster int, distance long")


def moved(rows: DataFrame, assigner: Assigner) -> np.ndarray:
    """The centroids after one round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dims = assigner.c.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                v, cached = _arrays(batch.iloc[lo:lo + 4096])
                own, _, _ = assigner.nearest(v, cached)
                n += np.bincount(own, minlength=k)
                np.add.at(total, own, v)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    parts = rows.mapInPandas(run, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
    sums = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = assigner.c.copy()
    for r in sums.collect():  # one row per centroid and component
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
            salt: str = SALT) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    rows = kept(vectors, id_col, vector_col, dims)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    start = rows.withColumn("h", order).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    pivots = choose_pivots(centroids)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.stack(batch["v"].to_numpy()).astype(np.int64) if len(batch) else np.zeros((0, dims), np.int64)
            yield batch.assign(cached=list(np.stack([squared(v, p) for p in pivots], axis=1)))

    rows = staged(rows.mapInPandas(measure, "id long, v array<int>, cached array<long>"))
    for _ in range(rounds):
        centroids = moved(rows, Assigner(centroids, pivots))
    out = staged(assigned(rows, Assigner(centroids, pivots)))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = rows.sparkSession.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = staged(sums.join(named, "cluster"))  # at most k rows
    whole = sums.agg(F.sum("s").alias("all"))
    sums = sums.join(F.broadcast(whole)).select("cluster", _bigint(F.col("s")).alias("cluster_inertia"), _bigint(F.col("all")).alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(sums), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(vectors: DataFrame) -> DataFrame:
    return cluster(vectors)


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, salt: str = SALT) -> str:
    parts = [f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor(256 * e) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM v
  ORDER BY sha256('{salt}:' || vec_id), v LIMIT {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, vec_id, v, cluster, distance FROM (
    SELECT r, vec_id, v, cluster, distance, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS nth FROM (
      SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) AS BIGINT) AS distance FROM v, c{n}))
  WHERE nth = 1)""")
        if n < rounds:
            parts.append(f"""
m{n} AS (
  SELECT cluster, list(x ORDER BY pos) AS c FROM (
    SELECT cluster, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (
      SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS pos FROM a{n}) GROUP BY cluster, pos) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


OP12_SQL = _sql()
