"""Approximate nearest neighbours by largest inner product, with multi-index hashing.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest angle. Binary codes are
the signs after rotations learned on a bounded sample (iterative quantisation, one rotation for as many bits as there are
components). A code is cut into 16-bit substrings, each with its own inverted index. By the pigeonhole principle a code within
Hamming distance r = m * s + a (m substrings, a < m) is within s in one of the first a + 1 substrings or within s - 1 in one of the
others, so probing these balls retrieves every code within r. What they retrieve and lies within r is ranked by inner products in
double precision. The radius is learned on distinct vectors of the sample as a high quantile of the distances to true neighbours.
Queries that find fewer than k rows, or whose k-th angle is not covered by the radius (the expected distance of codes at that angle
and two standard deviations), are probed again with a growing radius, at last all rows.

All rows are indexed, in blocks; queries go to every block in blocks, and the best of the blocks are merged. Vectors that are null,
zero, hold a null or non-finite component or differ in length from the first valid vector take no part. A query's own id is no
candidate. Repeated rows are candidates each. A null id takes no part. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import hash_sample, staged

K = 20
BITS = 128
#: Vectors on which rotations and radius are learned, at most.
SAMPLE_ROWS = 8_192
#: Share of true neighbours that the radius is to hold on the sample.
COVER = 0.985
BLOCK = 16_384
QUERY_BLOCK = 1_024
_SUB = 16


@dataclass
class Codes:
    """Learned coding: mean and rotations in the space with the added component, the largest norm, and the radius."""

    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int = 0

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        sq = (x * x).sum(axis=1)
        if query:
            return np.column_stack([x * (self.norm / np.sqrt(sq))[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - sq, 0))])

    def code(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """uint16 substrings, one row a vector."""
        bits = (self.lift(x, query) - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the codes a (rows) and b (columns)."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return sum(np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.int16) for w in range(a.shape[1]))


def learn(sample: np.ndarray, norm: float, bits: int = BITS, rounds: int = 25, seed: int = 7) -> Codes:
    """Rotations by iterative quantisation: codes and rotation are fitted to each other in turn."""
    draw = np.random.default_rng(seed)
    codes = Codes(np.zeros(sample.shape[1] + 1), np.zeros((0, 0)), norm)
    lifted = codes.lift(sample, False)
    codes.mean = lifted.mean(axis=0)
    x = lifted - codes.mean
    found = []
    while sum(r.shape[1] for r in found) < bits:
        r = np.linalg.qr(draw.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        found.append(r)
    codes.rotation = np.concatenate(found, axis=1)[:, :bits]
    return codes


def set_radius(codes: Codes, sample: np.ndarray, total: int, k: int, cover: float = COVER, seed: int = 7) -> None:
    """Learns the radius: the sample's nearest few stand for the k nearest of all rows. Copies count once, as they are near any radius."""
    known = np.unique(sample, axis=0)
    asks = np.random.default_rng(seed).permutation(len(known))[:512]
    queries = known[asks]
    score = queries @ known.T
    if len(known) > 1:
        score[np.arange(len(asks)), asks] = -np.inf
    few = max(1, min(len(known) - 1, round(k * len(sample) / max(total, 1))))
    near = np.argsort(-score, axis=1)[:, :few]
    far = np.take_along_axis(distance(codes.code(queries, True), codes.code(known)), near, axis=1)
    codes.radius = int(np.quantile(far, cover, method="higher"))


class Block:
    """An indexed block: for each substring its distinct values with their rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.index = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]

    def probe(self, sub: int, values: np.ndarray, reach: int) -> np.ndarray:
        """Per query value, which rows have a value of this substring within `reach`."""
        keys, rows = self.index[sub]
        ball = sum(1 for n in range(reach + 1) for _ in combinations(range(_SUB), n)) if 0 <= reach <= 2 else len(keys)
        if reach < 0:
            return np.zeros((len(values), len(rows)), bool)
        if ball < len(keys) // 8:  # look up each value of the ball
            masks = np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(_SUB), n)], np.uint16)
            want = values[:, None] ^ masks[None, :]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.zeros((len(values), len(keys)), bool)
            q, m = np.nonzero(keys[at] == want)
            hit[q, at[q, m]] = True
        else:  # the ball holds more values than the index: go through those of the index
            hit = np.bitwise_count(values[:, None] ^ keys[None, :]) <= reach
        return hit[:, rows]

    def search(self, ids: np.ndarray, q: np.ndarray, codes: np.ndarray, radius: int, k: int) -> list[tuple]:
        """(query, candidate, score) of the k best within the radius."""
        m = self.codes.shape[1]
        reach, rest = divmod(radius, m)
        hit = np.zeros((len(ids), len(self.ids)), bool)
        for s in range(m):
            hit |= self.probe(s, codes[:, s], reach if s <= rest else reach - 1)
        hit &= distance(codes, self.codes) <= radius
        hit &= ids[:, None] != self.ids[None, :]
        out = []
        for n in range(len(ids)):
            rows = np.flatnonzero(hit[n])
            score = (self.x[rows] * q[n]).sum(axis=1)
            if len(rows) > k:
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[best], score[best]
            order = np.lexsort((self.ids[rows], -score))[:k]
            out += [(int(ids[n]), int(v), float(z)) for v, z in zip(self.ids[rows[order]], score[order], strict=True)]
        return out


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """(block, ids, vectors): `size` rows a block on average, as bytes."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(max(1, -(-total // size)))).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x = np.array(part["x"].tolist(), dtype=np.float64)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})

    return dealt.groupBy("block").applyInPandas(build, "block int, ids binary, vectors binary")


def nearest(rows: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS,
            cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which `queries` holds."""
    schema = "query_id long, rank int, vec_id long, score double"
    x = F.col(vector_col).cast("array<double>")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _valid(F.col("x")))
    clean = staged(clean)
    first = clean.agg(F.min(F.struct("id", F.size("x").alias("n")))).first()[0]
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = first["n"]
    clean = clean.where(F.size("x") == d)
    total, asked, norm = clean.agg(F.count("*"), F.count_if("asks"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()
    if not asked:
        return rows.sparkSession.createDataFrame([], schema)
    sample = np.array([r["x"] for r in hash_sample(clean, SAMPLE_ROWS, "id").orderBy("id", "x").collect()])
    bits = -(-bits // 64) * 64
    codes = learn(sample, norm, bits)
    set_radius(codes, sample, total, k, cover)

    def run(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b_ids, b_x, q_ids, q_x in zip(batch["ids"], batch["vectors"], batch["q_ids"], batch["q_vectors"], strict=True):
                bx = np.frombuffer(b_x).reshape(-1, d)
                block = Block(np.frombuffer(b_ids, np.int64), bx, codes.code(bx))
                ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q_x).reshape(-1, d)
                q_codes = codes.code(q, True)
                for lo in range(0, len(ids), 128):
                    part = slice(lo, lo + 128)
                    yield pd.DataFrame(block.search(ids[part], q[part], q_codes[part], radius, k), columns=["query_id", "vec_id", "score"])

    blocks = staged(_blocks(clean.select("id", "x"), BLOCK, total))
    n_blocks = max(1, -(-total // BLOCK))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def probed(queries_: DataFrame, count: int, radius: int) -> DataFrame:
        asks = _blocks(queries_, QUERY_BLOCK, count)
        asks = asks.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        found = blocks.join(asks, "block").mapInPandas(lambda batches: run(batches, radius), "query_id long, vec_id long, score double")
        return staged(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    todo, count, radius, out = clean.where("asks").select("id", "x").distinct(), asked, codes.radius, None
    while True:
        found = probed(todo, count, radius)
        if radius >= bits:
            return found if out is None else out.union(found)
        last = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
        share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (size * F.lit(norm))))) / F.lit(np.pi)
        covered = (F.col("n") >= k) & (bits * share + 2 * F.sqrt(bits * share * (1 - share)) <= radius)
        lost = staged(todo.join(last, "id", "left").where(~F.coalesce(covered, F.lit(False))).select("id").distinct())
        done = found.join(lost, found["query_id"] == lost["id"], "left_anti")
        out = done if out is None else out.union(done)
        todo = staged(todo.join(lost, "id", "left_semi"))
        count = todo.count()
        if not count:
            return out
        radius = min(bits, radius + max(bits // 16, radius // 2))


def op3(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
